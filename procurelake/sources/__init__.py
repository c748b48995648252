"""Scans of every layer, each with an explicit schema."""
