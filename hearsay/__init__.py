"""hearsay: infers what a backend does from the traffic it was heard to answer, on Spark DataFrames."""
