"""``python -m millrace run|serve|validate|graph|list``."""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading

from .plans import JobStore, build, catalog, load, render
from .plans.spec import JobError


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("millrace")
    sub = parser.add_subparsers(dest="do", required=True)
    run = sub.add_parser("run", help="runs a job over a bounded number of generated rows")
    run.add_argument("job")
    run.add_argument("--rows", type=int, default=1000)
    serve = sub.add_parser("serve", help="the control plane over a folder of jobs; MILLRACE_TOKEN sets a token")
    serve.add_argument("folder")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--host", default="127.0.0.1")
    for name in ("validate", "graph"):
        p = sub.add_parser(name)
        p.add_argument("job")
        if name == "graph":
            p.add_argument("--format", default="mermaid")
    listing = sub.add_parser("list")
    listing.add_argument("folder", nargs="?")
    sub.add_parser("version")
    opts = parser.parse_args(args)
    try:
        if opts.do == "version":
            print("0.1")
        elif opts.do == "list":
            print("\n".join(JobStore(opts.folder).names()) if opts.folder else json.dumps(catalog(), indent=2, default=str))
        elif opts.do == "serve":
            from pyspark.sql import SparkSession

            from .plans import Control, Runner

            spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
            control = Control(Runner(spark, JobStore(opts.folder)), opts.port, opts.host, os.environ.get("MILLRACE_TOKEN"))
            print(f"http://{opts.host}:{control.port}", flush=True)
            try:
                threading.Event().wait()
            except KeyboardInterrupt:
                control.close()
        else:
            with open(opts.job) as f:
                spec = load(f.read())
            if opts.do == "validate":
                print(f"{spec.name}: {len(spec.stages)} stages")
            elif opts.do == "graph":
                print(render(spec, opts.format), end="")
            else:
                from pyspark.sql import SparkSession

                spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
                for row in build(spark, spec, bounded=opts.rows).run() or ():
                    print(json.dumps(row, default=str))
    except (JobError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
