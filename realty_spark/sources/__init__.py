"""Sources of the property-transaction engine."""
