"""Lodestar: grounded-retrieval analytics and training-data operators on PySpark."""
