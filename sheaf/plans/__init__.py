"""plans of the sheaf engine."""
