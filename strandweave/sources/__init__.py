"""Readers and writers of graph, alignment, sequence and path files; all lines are read and written by Spark."""
