"""Operators for training-data pipelines over tables of documents, pages and vectors.

Nothing else in the package imports this folder. Every operator takes and returns DataFrames; work inside a
task runs in Arrow batches of bounded size, and all that crosses tasks goes through Spark shuffles.
"""
