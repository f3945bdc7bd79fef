"""Operators over DataFrames keyed by document. Each is a pure function of its arguments."""
