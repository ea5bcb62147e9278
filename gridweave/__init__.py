"""Gridweave: sparse-structure analytics, row and column orders and reporting on Spark DataFrames."""
