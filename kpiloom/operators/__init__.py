"""Analytical operators. Each takes and returns DataFrames."""
