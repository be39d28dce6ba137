"""Analysis operators: DataFrames in, DataFrames out."""
