"""gridreach operators."""
