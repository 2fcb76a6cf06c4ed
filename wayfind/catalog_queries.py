"""Imports every module that registers queries."""

from wayfind.suite import history, parsing, reports, scalars, streams, structure, syntax, trees  # noqa: F401
