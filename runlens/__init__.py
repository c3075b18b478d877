"""Run analytics on Spark: extrema, crossings, violations, requirements and budgets over many runs at once."""

__version__ = "0.1.0"
