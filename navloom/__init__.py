"""navloom: fund portfolio analytics as Spark jobs."""
