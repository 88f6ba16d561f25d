"""Loads every module that registers queries."""

from brokerlake.plans import q_boards, q_functions, q_ingestion, q_lifecycle, q_rates, q_resolution  # noqa: F401
