"""Adapters, whole pipelines, the command line and the registered queries."""
