"""Progress streams and their state."""
