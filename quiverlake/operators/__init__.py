"""Backends: each turns a table of vectors into an index that answers batches of queries."""
