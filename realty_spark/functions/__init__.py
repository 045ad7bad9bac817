"""Functions of the property-transaction engine."""
