"""Event tables: the canonical schema, adapters, named sources and sinks."""
