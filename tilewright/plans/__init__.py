"""Compositions of operators: tile stages, annotation import, and the registered queries."""
