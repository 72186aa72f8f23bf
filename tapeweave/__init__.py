"""Market-microstructure analytics and corpus preparation on Spark."""
