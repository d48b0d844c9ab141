"""glosswork: Spark-first building, searching, guarding and measuring of text corpora."""
