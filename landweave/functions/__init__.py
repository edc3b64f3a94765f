"""landweave.functions."""
