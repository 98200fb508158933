"""Readers of files and tables, sinks, and a catalog of data sets and indexes."""
