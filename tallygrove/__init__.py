"""Posting analytics on Spark: parameterised DataFrame operators, sources, functions, plans and streams."""
