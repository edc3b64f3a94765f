"""landweave.operators."""
