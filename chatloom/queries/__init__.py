"""Registered queries over the given tables, each with the SQL it must agree with."""

from chatloom.queries import base, conversations, documents, embeddings, events, graph, names, orders, quality, streams  # noqa: F401
from chatloom.queries.base import ORACLES, QUERIES  # noqa: F401
