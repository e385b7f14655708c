"""Readers, writers and the stores that stages keep between each other."""
