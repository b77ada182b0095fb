"""Spark-native operators for lakehouse tables and model operations.

Every operator takes DataFrames and returns a DataFrame; sinks are separate functions in
``lakeops.sources``. Nothing here keeps global state.
"""
