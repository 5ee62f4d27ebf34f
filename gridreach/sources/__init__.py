"""gridreach sources."""
