"""newstide: temporal document-stream analytics on PySpark."""
