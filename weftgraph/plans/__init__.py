"""Whole plans: building a graph of source files, and the registered queries."""
