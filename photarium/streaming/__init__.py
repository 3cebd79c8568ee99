"""Structured Streaming variants of the latest-state and hash-gate operators."""
