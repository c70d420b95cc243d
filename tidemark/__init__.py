"""Market-stress analytics and time-series operators on Spark."""
