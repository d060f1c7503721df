"""outlog streaming."""
