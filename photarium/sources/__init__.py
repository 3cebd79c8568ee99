"""Readers: file listings, file bytes, decoded images, probe documents."""
