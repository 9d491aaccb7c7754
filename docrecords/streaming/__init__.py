"""Incremental record building."""
