"""plausia: evidence-weighted analytics over discussion data, written for Spark."""
