"""tagweave.plans."""
