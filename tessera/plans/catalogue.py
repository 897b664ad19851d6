"""Imports every module of queries, so that they register."""

from tessera.plans import changes, decisions, domain, flows, providers, scans, totals, upkeep  # noqa: F401
