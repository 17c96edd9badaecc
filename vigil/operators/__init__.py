"""Operators: each a DataFrame -> DataFrame job."""
