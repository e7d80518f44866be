"""Relational, graph and snapshot operators on DataFrames."""
