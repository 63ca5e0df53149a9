"""Corpus building and detection analytics as PySpark DataFrame operators."""
