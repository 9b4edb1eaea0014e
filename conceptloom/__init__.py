"""conceptloom: ontology analytics and corpus preparation on Spark DataFrames."""
