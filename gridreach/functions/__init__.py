"""gridreach functions."""
