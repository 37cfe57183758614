"""voxloom: spoken-command analytics as Spark DataFrame jobs."""
