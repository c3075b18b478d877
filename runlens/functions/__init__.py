"""Functions over sample frames and the expression language."""
