"""Semantic index over a corpus of text or source files, as Spark DataFrame plans."""
