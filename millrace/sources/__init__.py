from .readers import frame_files, generator, http_landing, kafka_options, memory, parallel, read_files, read_frames, read_kafka, read_kafka_frames, template
from .writers import collect_rows, discard, idempotent_batch, post_batch, to_frames, to_kafka, write_ndjson

__all__ = ["collect_rows", "discard", "frame_files", "generator", "http_landing", "idempotent_batch", "kafka_options", "memory", "parallel", "post_batch", "read_files", "read_frames", "read_kafka", "read_kafka_frames", "template", "to_frames", "to_kafka", "write_ndjson"]
