"""All registered queries."""

from . import aggregates, crosssections, joins, more, parts, scalars, sources, streams, windows
from .crosssections import flagship
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "crosssections", "flagship", "joins", "more", "parts", "scalars", "sources", "streams", "windows"]
