"""Operators for preparing training text, and their driver queries.

Nothing else in the library imports this subpackage.
"""
