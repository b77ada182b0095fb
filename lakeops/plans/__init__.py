"""Compositions of operators into whole jobs."""
