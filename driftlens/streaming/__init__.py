"""Structured Streaming delivery of the batch operators: incremental
scoring of newly landed text files and a running label distribution."""
