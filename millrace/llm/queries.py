"""Loads every module that registers a query of this subpackage."""

from __future__ import annotations

from millrace.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13  # noqa: F401
from millrace.llm.registry import QUERIES, SQL  # noqa: F401
