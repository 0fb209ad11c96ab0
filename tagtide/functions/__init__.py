"""Column-level building blocks: bucket arithmetic, series ids, aggregates."""
