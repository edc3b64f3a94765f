"""landweave.streaming."""
