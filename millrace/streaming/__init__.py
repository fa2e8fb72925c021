from .evolution import evolving_sink
from .observe import Progress, Quarantine, ancestors, export_lineage, lineage_edges, prometheus, roots, stamp, tap, with_parents
from .stateful import stream_bounded_join, stream_count_aggregate, stream_count_window, stream_deduplicate
from .windows import drain, stream_interval_join, stream_sessions, stream_sliding, stream_tumbling

__all__ = [
    "Progress", "Quarantine", "ancestors", "drain", "evolving_sink", "export_lineage", "lineage_edges", "prometheus", "roots", "stamp", "stream_bounded_join", "stream_count_aggregate", "stream_count_window", "stream_deduplicate",
    "stream_interval_join", "stream_sessions", "stream_sliding", "stream_tumbling", "tap", "with_parents",
]
