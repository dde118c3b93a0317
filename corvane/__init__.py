"""Dataset audit, split, leakage and model-evaluation engine on Spark DataFrames."""
