"""Plans of the property-transaction engine."""
