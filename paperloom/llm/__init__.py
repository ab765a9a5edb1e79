"""Operators for preparing training text at lake scale.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
