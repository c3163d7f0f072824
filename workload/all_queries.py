"""Imports every module that registers queries."""

from . import lookup, projects, relations, reviews, services, snapshots, spans, texts, workflows  # noqa: F401
