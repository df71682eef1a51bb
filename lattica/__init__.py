"""A PySpark engine for graphs, ratings and text: plain DataFrames in, plain DataFrames out."""
