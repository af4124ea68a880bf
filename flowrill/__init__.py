"""Network-flow analytics and denial-of-service detection as PySpark DataFrame operators."""
