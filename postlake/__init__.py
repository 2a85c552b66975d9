"""postlake: posting-style analytics as Spark DataFrame transforms."""
