"""Contract screening and text analytics on PySpark DataFrames."""
