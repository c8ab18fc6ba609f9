"""Frames, series and selectors: plans over labelled rows."""
