"""Questions a user asks, each composed of operators; every result is a DataFrame or a dict of named DataFrames."""
