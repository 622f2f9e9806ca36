"""Registered queries: domain frames from the driver tables, run through the operators."""
