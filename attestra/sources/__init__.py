"""Readers and writers of the evidence graph's files, as DataFrames with fixed schemas."""
