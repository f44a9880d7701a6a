"""Readers and writers of pixel, point, polygon and observation tables."""
