"""Code-change impact analysis over many repositories and commits, as Spark jobs."""
