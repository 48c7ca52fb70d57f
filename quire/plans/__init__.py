"""Registered queries: operators applied to whole tables, each with its SQL for the oracle."""
