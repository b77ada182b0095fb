"""Scans, sinks and the fixed schemas of the event tables."""
