"""Feeds, realtime dumps and observation tables."""
