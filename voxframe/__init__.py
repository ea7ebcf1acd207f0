"""Analytics over time-aligned speech segments, on Spark."""
