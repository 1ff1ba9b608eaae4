"""The registered queries: every job of the library run over the driver's tables, with SQL that checks it."""

from __future__ import annotations

from workload.registry import ORACLES, QUERIES  # noqa: F401
from workload import cases, feeds, graphs, intake, lexical, pages, probes, serving, store, streams  # noqa: F401, E402
