"""Text-classification analytics as PySpark DataFrame functions."""
