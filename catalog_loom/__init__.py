"""Batch jobs for a media catalog, as plain functions from DataFrames to DataFrames."""
