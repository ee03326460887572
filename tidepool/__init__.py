"""Tidepool: ordered, versioned key-value data as Spark DataFrames."""
