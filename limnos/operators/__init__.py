"""Relational and statistical operators, one module per part of the analysis."""
