"""The registered queries of the graph engine and their SQL."""

from __future__ import annotations

from weftgraph.queries import QUERIES, SQL, flows, inputs, messages, structures, temporals, traversal  # noqa: F401
