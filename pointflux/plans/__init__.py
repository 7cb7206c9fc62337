"""Registered queries over the driver's tables and their SQL counterparts."""

from . import assets, files, joins, layout, models, sampling, scalars, selection, stats, temporal  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
