"""lodestrata: dataset curation and evaluation analytics on PySpark."""
