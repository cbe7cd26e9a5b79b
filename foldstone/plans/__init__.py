"""Query catalogues: each module maps names to plans and, where SQL can say it, to oracle text."""
