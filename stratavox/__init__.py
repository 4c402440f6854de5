"""Block-world level-of-detail analytics on PySpark."""
