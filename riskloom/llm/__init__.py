"""Operators that turn collected reports into training data, and their queries.

Nothing else in the library imports this package.
"""
