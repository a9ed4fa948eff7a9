"""Mail content analytics on PySpark."""
