"""Operators for preparing training text, each on its own and as one corpus pipeline.

Nothing else in the library imports this subpackage.
"""
