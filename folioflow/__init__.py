"""Document-record analytics on PySpark."""
