"""landweave.plans."""
