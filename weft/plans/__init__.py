"""Query documents, their compilation to DataFrames, and the type contracts."""
