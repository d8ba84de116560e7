"""Spark-native siting analytics: cells, infrastructure, scores and their lineage as DataFrames."""
