"""maxloom: late-interaction retrieval analytics on PySpark DataFrames."""
