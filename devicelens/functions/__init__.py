"""Scalar column builders: business rules, dates, text."""

from devicelens.functions import dates, rules

__all__ = ["dates", "rules"]
