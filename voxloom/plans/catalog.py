"""Imports every query module so that the registry is complete."""

from voxloom.plans import (  # noqa: F401
    command_queries,
    evidence_queries,
    file_queries,
    journal_queries,
    report_queries,
    search_queries,
    stream_queries,
)
from voxloom.plans.registry import REGISTRY  # noqa: F401
