"""Spark-native ledger of usage records: readers, operators, analytics and streams over DataFrames."""
