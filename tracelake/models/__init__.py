"""Detectors over windows and sequences."""
