"""Shapes, predicates and the operators that use them."""
