"""tagweave.operators."""
