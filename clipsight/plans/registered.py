"""Imports every module that registers queries."""

from clipsight.plans import (  # noqa: F401
    queries_catalog,
    queries_corpus,
    queries_evaluate,
    queries_files,
    queries_motion,
    queries_review,
    queries_structure,
)
from clipsight.plans.registry import QUERIES  # noqa: F401
