"""Retail order cleaning and reporting on Spark DataFrames."""
