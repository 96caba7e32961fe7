"""karst: entity-record analytics on Spark DataFrames."""
