"""Operators of a training-data pipeline: one module for each, with its query and, where SQL can state the result, its SQL."""
