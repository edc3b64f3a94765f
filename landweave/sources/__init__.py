"""landweave.sources."""
