"""Statistics as column expressions."""
