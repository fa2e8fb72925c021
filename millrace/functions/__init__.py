from .specs import aggregates, arithmetic, compare, duration, merge_aggregates, seconds, zero_nulls

__all__ = ["aggregates", "arithmetic", "compare", "duration", "merge_aggregates", "seconds", "zero_nulls"]
