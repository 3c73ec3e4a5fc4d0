"""Windowed analytics over time-stamped and sequenced rows, compiled to DataFrame plans."""
