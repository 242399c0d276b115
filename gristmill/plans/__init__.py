from gristmill.plans import landing, merging, offers, records, rules, stored  # noqa: F401
from gristmill.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
