"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
per operator.
"""
