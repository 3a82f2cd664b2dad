"""operators of the sheaf engine."""
