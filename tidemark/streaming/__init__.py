"""Streaming forms of weekly volatility, rolling z-scores and the variance filter (extensions: the study itself is batch)."""
