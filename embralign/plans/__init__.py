"""Queries over the driver tables and their SQL, in catalogue and extended (one registry)."""

from . import catalogue, extended  # noqa: F401
