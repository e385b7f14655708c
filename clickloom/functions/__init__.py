"""Column helpers: every function takes and gives ``Column``s, so Catalyst sees all of it."""
