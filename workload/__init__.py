"""Registered queries over the given tables, each with its oracle SQL beside it."""

from workload import q_eval, q_files, q_linking, q_retry, q_schema, q_text, q_training, q_vectors  # noqa: F401
from workload.registry import ORACLE, QUERIES  # noqa: F401
