"""Incremental ingest of daily billing exports and metric buckets with Structured Streaming."""

from costlens.streaming.ingest import billing_stream, metric_buckets_stream, start_ingest

__all__ = ["billing_stream", "metric_buckets_stream", "start_ingest"]
