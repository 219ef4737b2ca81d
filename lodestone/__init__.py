"""Spark-native entity resolution and data processing, expressed with DataFrames."""
