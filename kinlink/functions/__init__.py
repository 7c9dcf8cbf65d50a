"""Column functions: normalisers, grams and blocking keys."""
