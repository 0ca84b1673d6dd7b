"""Multi-pass building blocks (saved tables, global order, quantiles, skew-safe lookups)."""
