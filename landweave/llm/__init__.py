"""Operators on texts, names, addresses and vectors; nothing outside this subpackage imports it."""
