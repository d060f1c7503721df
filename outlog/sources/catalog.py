"""Sources and sinks by name, as a configuration would name them."""

from __future__ import annotations

from typing import Callable

from . import logs, sinks

SOURCES: dict[str, Callable] = {
    "local.source": logs.read_logs,
    "localdir.source": logs.read_log_dir,
    "table.source": logs.window_read,        # date-partitioned table + time window
}

SINKS: dict[str, Callable] = {
    "local.sink": sinks.write_json,
    "table.sink": sinks.write_partitioned,
    "kafka.sink": sinks.write_kafka,
    "stdout.sink": sinks.feedback_links,
}

# index-backed names used by existing configurations map onto the table reader / writer
ALIASES = {"es.source": "table.source", "es.sink": "table.sink"}


def _lookup(table: dict, name: str, kind: str) -> Callable:
    key = name if name.endswith(f".{kind}") else f"{name}.{kind}"
    key = ALIASES.get(key, key)
    if key not in table:
        raise ValueError(f"unknown {kind}: {name!r} (known: {sorted(table)})")
    return table[key]


def get_source(name: str) -> Callable:
    """Reader for ``name`` (``local``, ``localdir``, ``table``/``es``, with or without ``.source``)."""
    return _lookup(SOURCES, name, "source")


def get_sink(name: str) -> Callable:
    """Writer for ``name`` (``local``, ``table``/``es``, ``kafka``, ``stdout``)."""
    return _lookup(SINKS, name, "sink")
