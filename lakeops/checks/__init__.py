"""Registered queries: every operator over the driver tables, beside an independent SQL statement."""

from lakeops.checks import cleaning, documents, drifting, events, evaluation, lifecycle, policies, profiling, specs, training
from lakeops.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "documents", "drifting", "evaluation", "events", "lifecycle", "policies",
           "profiling", "specs", "training"]
