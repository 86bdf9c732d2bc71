"""Vector-index, clustering and evaluation operators on PySpark DataFrames."""
