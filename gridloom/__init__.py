"""gridloom: analytics over two-dimensional axis-aligned boxes, declared with Spark DataFrames."""
