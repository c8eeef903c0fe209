"""Imports every query module so that the registry is complete."""

from foretime.plans import q_audit, q_ingest, q_model, q_prior, q_report, q_score, q_store, q_stream  # noqa: F401
from foretime.plans.registry import ORACLES, QUERIES  # noqa: F401
