"""Sources and sinks: catalogues, strict JSON, caches, checks, indexes."""
