"""Declarative operator-tree plans compiled to Spark DataFrames."""
