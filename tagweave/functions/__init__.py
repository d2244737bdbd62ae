"""tagweave.functions."""
