"""Spark-native engine for ordered event logs: replay, audit, state and factors as DataFrames."""
