"""Registered queries, grouped by subject; importing the package fills the registry."""

from fabsight.reports import relational, maintenance, series, evaluation, retrieval, conversations, detection, streams, exchange  # noqa: F401
