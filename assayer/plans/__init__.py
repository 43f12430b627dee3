"""Whole runs: models, training and the audit document."""
