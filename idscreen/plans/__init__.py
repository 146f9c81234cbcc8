"""Whole queries: the flagship screening report and the registered query catalogue."""
