"""Structured Streaming: exactly-once incremental maintenance of the daily rollup."""
