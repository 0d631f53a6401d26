"""Conversational-memory analytics as PySpark DataFrame operators."""
