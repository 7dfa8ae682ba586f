"""Checks of bars as they arrive."""
