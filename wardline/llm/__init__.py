"""Operators on texts and entities for training-data pipelines. Nothing else in the library imports this."""
