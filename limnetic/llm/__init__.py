"""Operators of a training-data pipeline over ``documents`` and ``labels``.

Importing the subpackage registers its queries in ``QUERIES`` and their SQL in
``ORACLES``. Nothing else in the library imports it.
"""

from limnetic.llm import queries as _queries  # noqa: F401
from limnetic.llm.register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
