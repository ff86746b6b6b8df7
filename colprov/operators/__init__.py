"""The audit operators. Every function takes and returns DataFrames."""
