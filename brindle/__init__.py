"""Analytics on Spark: profiling, validation, features, clustering, search."""
