"""grovekit: incremental trees, boosting and clustering as Spark DataFrame plans."""
