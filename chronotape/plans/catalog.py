"""All registered queries."""

from . import queries_bars, queries_extra, queries_quality, queries_registries, queries_research, queries_rubric, queries_tape  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
