"""Operators over collections of media items: each takes and returns DataFrames, for all albums at once."""
