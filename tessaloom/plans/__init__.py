"""Declarative plans compiled to DataFrames."""
