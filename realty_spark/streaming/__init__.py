"""Streaming of the property-transaction engine."""
