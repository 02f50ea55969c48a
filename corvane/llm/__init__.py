"""Operators for the text and algorithm problems of training-data pipelines."""
