"""helixframe: sequence-text analytics on Spark DataFrames."""
