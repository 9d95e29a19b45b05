"""Scoring of claims as they arrive."""
