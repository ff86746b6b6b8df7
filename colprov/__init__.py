"""colprov: column-provenance (target-leakage) audit on Spark DataFrames."""
