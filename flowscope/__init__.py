"""Network-flow analytics as plain PySpark DataFrame operators."""
