"""Column expressions: rounding, guarded ratios and percents (numeric), CASE banding and labels (bands)."""
