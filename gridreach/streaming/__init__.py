"""gridreach streaming."""
