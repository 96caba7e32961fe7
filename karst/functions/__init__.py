"""Scalar functions: Column in, Column out, no UDF where Spark has the means."""
