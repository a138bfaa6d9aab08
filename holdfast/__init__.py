"""Subscription-retention analytics on Spark DataFrames."""
