"""Scan jobs and the run log."""
