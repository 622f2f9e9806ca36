"""Reading and writing tables, and the domain frames built from the driver tables."""
