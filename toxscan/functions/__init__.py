"""Column functions: text cleaning (T1-T11) and URL keys (K1, K4-K6)."""
