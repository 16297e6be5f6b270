"""Imports every module of queries, so that the registry is full."""

from . import access, find, intake, law, lookups, metrics, reading, relations, streams, temporal, texts, writes  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
