"""Operators on pages, sub time frames and time frames: DataFrame to DataFrame."""
