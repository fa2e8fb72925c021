from .catalog import catalog
from .compile import Built, Running, build, register_operator, register_sink, register_source
from .graph import render
from .spec import Sink, Source, Spec, Stage, dump, load, parse, use_profile, validate
from .server import Control
from .store import JobStore, Run, Runner

__all__ = ["Built", "Control", "JobStore", "Run", "Runner", "Running", "Sink", "Source", "Spec", "Stage", "build", "catalog", "dump", "load", "parse", "register_operator", "register_sink", "register_source", "render", "use_profile", "validate"]
