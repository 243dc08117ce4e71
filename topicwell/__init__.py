"""Topic-stream analytics on PySpark: load, route, number, fan out and read back
topic-organised events with DataFrame expressions, joins and windows."""
