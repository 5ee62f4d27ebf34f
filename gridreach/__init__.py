"""gridreach: city-scale spatial accessibility analytics as PySpark DataFrame operators."""
