"""Every operator and pipeline as a named query over the given tables."""

from . import columns, filters, joins, aggregates, reshaping, scalars, pipelines_survey, pipelines_fish, pipelines_lab, stats  # noqa: F401,E501
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
