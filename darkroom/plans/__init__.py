"""Queries over the given tables, which stand for albums of photos."""
