"""outlog sources."""
