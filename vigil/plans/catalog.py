"""All registered queries, imported once so every module registers itself."""

from __future__ import annotations

from . import assurance, audit, fingerprint, governance, jobs, labels, model, questions, reports, stream  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
