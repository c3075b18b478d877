"""Plans over operators: previews, budgets, policies, verification."""
