"""Physical-plan helpers: blocked windows, skew-safe joins, checkpoints."""
