"""sources of the sheaf engine."""
