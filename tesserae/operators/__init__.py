"""Operators over DataFrames: indexes, retrieval, fusion, evaluation, corpus preparation."""
