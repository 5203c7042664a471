"""Record linkage and nested-metadata processing on Spark DataFrames."""
