"""outlog plans."""
