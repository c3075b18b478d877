"""Operators over sample frames: detection, resampling, events, sets of samples."""
