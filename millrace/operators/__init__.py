"""Operators: functions from DataFrames to DataFrames, for use with ``df.transform``."""

from .aggregate import global_aggregate, group_by, max_or_none, merge_partials, rollup_cube
from .basic import assign_timestamp, branch, distinct_union, except_all, filter_rows, flat_map, intersect_all, map_columns, merge, rename, set_constant, split, tag
from .dedup import deduplicate, keep_last
from .functions import aggregate_by, filter_by, flat_map_rows, map_batches, map_rows
from .joins import as_of_join, bounded_join, hash_join, interval_join, side_lookup
from .ordering import number_rows
from .schema import SchemaRegistry, adapt, to_struct
from .topn import top_n
from .windows import count_sliding, count_tumbling, event_sessions, event_sliding, event_tumbling, keyed_count_window

__all__ = [
    "SchemaRegistry", "adapt", "aggregate_by", "as_of_join", "assign_timestamp", "bounded_join", "branch", "count_sliding", "count_tumbling", "deduplicate", "distinct_union", "event_sessions",
    "event_sliding", "event_tumbling", "except_all", "filter_by", "filter_rows", "flat_map", "flat_map_rows", "global_aggregate", "group_by", "hash_join", "intersect_all", "interval_join", "keep_last",
    "keyed_count_window", "map_batches", "map_columns", "map_rows", "max_or_none", "merge", "merge_partials", "number_rows", "rename", "rollup_cube", "set_constant", "side_lookup", "split", "tag", "to_struct", "top_n",
]
