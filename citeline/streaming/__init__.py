"""Structured Streaming: TTL cache with per-key state (``ttl``), first-seen
dedup, page ingest and the available-now runner (``ingest``)."""
