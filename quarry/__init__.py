"""quarry: SQLite-dialect analytics on Spark DataFrames."""
