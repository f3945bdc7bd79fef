"""Keyed state over events, in batch and as streams."""
