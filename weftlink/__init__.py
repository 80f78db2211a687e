"""weftlink: record linkage and corpus work as Spark DataFrames."""
