"""Operators over streaming DataFrames."""
