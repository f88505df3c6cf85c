"""Reconciliation and audit analytics on Spark DataFrames."""
