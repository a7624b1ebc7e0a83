"""Queries over the engine's operators and the SQL that says the same."""
