"""Operators for training data, with their queries and SQL. Nothing else in the library imports this subpackage."""
