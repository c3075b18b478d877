"""Detectors over streams of samples."""
