"""Operators over flattened discussion data: each takes DataFrames and returns one."""
