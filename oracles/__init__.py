"""Independent DuckDB statements the Spark results are checked against."""
