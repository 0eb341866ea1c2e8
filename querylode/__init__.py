"""Querylode: SQL-workload analytics on Spark DataFrames."""
