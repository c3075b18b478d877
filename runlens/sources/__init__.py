"""Readers: signal files to sample frames, tables of requirements to rows of cells, discovery of runs."""
