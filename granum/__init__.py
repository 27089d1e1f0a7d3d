"""granum: entity queries, enrichment and corpus preparation as Spark DataFrame plans."""
