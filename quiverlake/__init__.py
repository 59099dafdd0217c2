"""Quiverlake: vector similarity search, clustering and corpus operators on Spark DataFrames."""
