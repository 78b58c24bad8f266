"""Ashlar: composable analytics operators over Spark DataFrames."""
