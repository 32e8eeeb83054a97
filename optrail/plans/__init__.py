"""Registered queries, their oracles and the experiments."""

from . import experiments, fixtures, registry

__all__ = ["experiments", "fixtures", "registry"]
