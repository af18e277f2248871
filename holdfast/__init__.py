"""Holdfast: corpus inventory, assessment and training-data preparation on Spark."""
