"""outlog operators."""
