"""Typed dataflow graphs compiled into single Spark query plans."""
