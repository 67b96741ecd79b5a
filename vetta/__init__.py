"""Security-finding and corpus analytics expressed as Spark DataFrame jobs."""
