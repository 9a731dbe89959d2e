"""Imports every plan module so that its queries are registered."""

import importlib

from tallyloom.plans.base import ORACLES, QUERIES

for _name in (
    "texts", "records", "payloads", "sessions", "jobs", "corpus", "packages", "workspace", "streams", "relational",
):
    importlib.import_module(f"tallyloom.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
