"""tagweave.sources."""
