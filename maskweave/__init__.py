"""Reversible redaction, restoration and training-data preparation on PySpark."""
