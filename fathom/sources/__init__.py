"""Sources: code trees as DataFrames."""
