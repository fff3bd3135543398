"""Lexforge: a Spark-native engine for analysing, compacting and governing text sent to and returned by language models."""

from lexforge.errors import HttpError, LexforgeError, RetentionError, require_retention
from lexforge.functions.text import count_tokens
from lexforge.operators.cost import cost_columns, risk_label
from lexforge.operators.governed import govern
from lexforge.operators.reports import run_report, run_totals
from lexforge.operators.retention import scores as retention_scores
from lexforge.plans.compress import guarded, run_chain
from lexforge.plans.optimize import Policy, optimize_requests
from lexforge.sources.io import call_model, write_csv, write_json
from lexforge.streaming.pacing import pace, rolling

__all__ = [
    "HttpError", "LexforgeError", "Policy", "RetentionError", "call_model", "cost_columns", "count_tokens", "govern", "guarded", "optimize_requests", "pace",
    "require_retention", "retention_scores", "risk_label", "rolling", "run_chain", "run_report", "run_totals", "write_csv", "write_json",
]
