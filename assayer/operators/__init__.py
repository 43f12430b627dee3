"""Measurements over tables."""
