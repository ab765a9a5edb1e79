"""Document-lake analytics on PySpark: DataFrame in, DataFrame out."""
