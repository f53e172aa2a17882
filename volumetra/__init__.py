"""Volumetric queries over large sets of 3-D elements, on PySpark."""
