"""netloom: packet-capture analytics on PySpark."""
