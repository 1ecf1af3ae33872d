"""Analysis, edit distance and scoring formulas."""
