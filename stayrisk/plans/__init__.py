"""Query catalog: importing this package registers every query."""

from . import dashboard, io, learning, modeling  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
