"""Queries over the driver's tables, each with its SQL."""

from . import analysed, analysis, answers, code, more, state, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analysed", "analysis", "answers", "code", "more", "state", "texts"]
