"""Readers that turn files or raw tables into element, attribute and relation DataFrames."""
