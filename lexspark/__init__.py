"""Pronunciation lexicons and candidate look-ups as Spark DataFrame plans."""
