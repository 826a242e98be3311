"""Full-text search and document analytics on PySpark DataFrames."""
