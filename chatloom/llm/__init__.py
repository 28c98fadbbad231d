"""Operators for building training corpora: one module for each operator, queries in ``queries``."""
