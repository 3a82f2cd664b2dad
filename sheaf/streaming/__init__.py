"""streaming of the sheaf engine."""
