"""De Bruijn graph sequence analytics as DataFrame, SQL and Structured Streaming operations."""
