"""Operators over DataFrames, each in a module of its own."""
