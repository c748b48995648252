"""Whole steps between layers, and the SQL questions asked of Gold."""
