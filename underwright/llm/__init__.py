"""Operators of a training-data pipeline: one module per operator, queries in ``underwright.llm.queries``."""
