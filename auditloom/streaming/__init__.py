"""Event feeds, batch and streaming."""
