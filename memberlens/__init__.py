"""Business analytics for multi-location membership companies, written for Spark."""
