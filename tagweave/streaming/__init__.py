"""tagweave.streaming."""
