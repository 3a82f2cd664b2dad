"""functions of the sheaf engine."""
