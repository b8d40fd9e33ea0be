"""All core queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from millrace.plans.registry import QUERIES, SQL

for _name in ("text", "records", "series", "pipeline"):
    import_module(f"millrace.plans.queries_{_name}")

__all__ = ["QUERIES", "SQL"]
