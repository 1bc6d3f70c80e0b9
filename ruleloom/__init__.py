"""Productions over facts and events, compiled to Spark DataFrames."""
