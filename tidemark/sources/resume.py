"""Loads of many sources that may be interrupted: each source counts as done with the very change that stores its rows.

The log of finished sources is the note of the table's manifest, so rows and log cannot part: what was stored is in the log,
what is not in the log was not stored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import Tables


def finished(tables: Tables, name: str) -> dict[str, str]:
    """Sources in the table and the marks they were loaded under."""
    stored = tables.manifest(name)
    return dict(stored["note"].get("sources", {})) if stored else {}


def load_sources(tables: Tables, name: str, sources: Mapping[str, str], read: Callable[[str], DataFrame], together: int = 16) -> list[str]:
    """Load the sources ({name: mark}) that the table lacks or holds under another mark; those loaded, in order.

    ``read`` gives the rows of one source, which are stored with its name in ``source``; a source without rows is done all
    the same.  ``together`` sources are stored by one change; a load that dies in between goes on after the last change and
    ends as one that did not.
    """
    done = finished(tables, name)
    todo = [s for s in sorted(sources) if done.get(s) != sources[s]]
    for begin in range(0, len(todo), together):
        part = todo[begin : begin + together]
        rows = None
        for s in part:
            mine = read(s).withColumn("source", F.lit(s))
            rows = mine if rows is None else rows.unionByName(mine)
        done |= {s: sources[s] for s in part}
        tables.replace_parts(name, rows, "source", {"sources": done}, drop=part)
    return todo


def purge(tables: Tables, name: str, sources) -> list[str]:
    """Remove sources, rows and log together, so that they are loaded anew; those that were there."""
    done = finished(tables, name)
    gone = sorted(set(sources) & set(done))
    if gone:
        tables.replace_parts(name, tables.read(name).limit(0), "source", {"sources": {s: m for s, m in done.items() if s not in gone}}, drop=gone)
    return gone
