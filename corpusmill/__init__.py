"""A Spark-first engine for preparing and analysing large text corpora."""
