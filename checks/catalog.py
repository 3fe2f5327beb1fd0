"""All registered queries. Importing a module registers its queries."""

from . import cleaning, evaluation, history, joins, pages, sources  # noqa: F401
from .fixtures import REG

__all__ = ["REG"]
