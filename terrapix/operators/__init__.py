"""Operators over pixel, segment, point and prediction tables."""
