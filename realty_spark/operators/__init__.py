"""Operators of the property-transaction engine."""
