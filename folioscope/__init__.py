"""Document-search analytics on Spark: DataFrame operators for corpus tables, ranking and evaluation."""
