"""Supply-chain analytics on Spark: conforming, quality gates, service and cost metrics."""
