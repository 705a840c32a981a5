"""Arriving files and events as streams."""
