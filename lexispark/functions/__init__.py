"""Column-level helpers (Column in, Column out)."""
