"""Plan-shaping helpers (skew-safe ordered computations) and the query catalogue."""
