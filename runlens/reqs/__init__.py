"""Engineering requirements: tables of them, their binding to runs, and verdicts over many runs at once."""
