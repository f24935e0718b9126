"""Operators on mention and clustering frames."""
