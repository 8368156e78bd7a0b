"""Entity resolution on Spark: prepare, block, match, evaluate and cluster records."""
