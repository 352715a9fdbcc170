"""Report operators: each takes logical input DataFrames and returns a lazy report."""
