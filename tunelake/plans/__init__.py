"""Plans: changes as rows (what, where, old, new) instead of side effects."""
