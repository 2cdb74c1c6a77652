"""Imports every group of registered queries."""

from eventide.plans import (  # noqa: F401
    q_transitions,
    q_segment,
    q_running,
    q_responses,
    q_events,
    q_memory,
    q_retrieval,
    q_streaming,
)
from eventide.plans.registry import ORACLES, QUERIES  # noqa: F401
