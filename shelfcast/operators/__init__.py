"""Operators: plain functions from DataFrame to DataFrame, one module per topic."""
