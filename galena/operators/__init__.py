"""Expression trees, their lowering to Spark, and everything built on them."""
