"""Panel analytics on Spark: an expression language over date x instrument data, back-tests, point-in-time lookups and selection statistics."""
