"""Search sessions: gaps between polls as tables, and running sessions as keyed stream state."""
