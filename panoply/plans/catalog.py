"""All registered queries of the engine and their oracle SQL, by name."""

from . import measured, roundtrips  # noqa: F401  their queries register themselves
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
