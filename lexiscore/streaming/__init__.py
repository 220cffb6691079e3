"""Scores of posts that keep arriving."""
