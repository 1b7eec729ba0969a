"""Streaming extras: read paths counted as alignments arrive, and windows over event time."""
