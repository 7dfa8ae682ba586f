"""Column and window helpers."""
