"""Sequence, alignment and statistics operators as Spark expressions and DataFrame plans."""
