"""Relational operators: ``(DataFrame, parameters) -> DataFrame``, lazy, no actions inside."""
