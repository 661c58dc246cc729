"""Structured Streaming: incremental ingest of dropped report files."""

from .ingest import ingest_stream, layout_mapping  # noqa: F401
