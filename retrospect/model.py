"""Vocabulary shared by the engine: record kinds, relations, settings, errors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# -- fixed values: the thirteen kinds of log records, in their order, their groups, and those that are not counted
KINDS = (
    "heap_insert", "heap_delete", "heap_update", "heap_hot_update", "heap_confirm", "heap_lock", "heap_inplace",
    "heap2_prune", "heap2_visible", "heap2_multi_insert", "heap2_lock_updated", "xlog_fpi", "xlog_fpi_for_hint",
)
GROUPS = {
    "heap_insert": "insert", "heap2_multi_insert": "insert", "heap_update": "update", "heap_hot_update": "update",
    "heap_inplace": "update", "heap_delete": "delete", "heap2_prune": "vacuum",
}
NOT_COUNTED = ("heap_confirm", "heap_lock", "heap2_visible", "heap2_lock_updated")
INSERTS, UPDATES, DELETES = ("heap_insert", "heap2_multi_insert"), ("heap_update", "heap_hot_update"), ("heap_delete",)
UNSUPPORTED = {
    "temporary": "temporary relations", "unlogged": "unlogged relations", "matview": "materialized views",
    "partitioned": "partitioned table parents", "catalog": "system catalogs",
}


class HistoryError(ValueError):
    """A history that cannot be given exactly."""


@dataclass(frozen=True)
class Index:
    """A unique index as the gate needs to know it."""

    columns: tuple
    primary: bool = False
    unique: bool = True
    immediate: bool = True
    predicate: bool = False
    expressions: bool = False


@dataclass(frozen=True)
class RelationInfo:
    """A table whose history can be asked for."""

    name: str
    kind: str = "table"
    indexes: tuple = field(default_factory=tuple)
    has_external: bool = False

    @property
    def keys(self) -> tuple:
        """Columns of the first index that identifies rows: primary, or unique and immediate, of
        plain columns over all rows. Nullable columns are allowed: null equals null."""
        for i in self.indexes:
            if (i.primary or (i.unique and i.immediate)) and not i.predicate and not i.expressions:
                return tuple(i.columns)
        return ()

    @property
    def mode(self) -> str:
        return "keyed" if self.keys else "bag"


def check_relation(info: RelationInfo) -> str:
    """``mode=... has_external=...``, or an error for kinds without row history."""
    if info.kind != "table":
        raise HistoryError(f"history does not support {UNSUPPORTED.get(info.kind, 'this relation kind')}")
    return f"mode={info.mode} has_external={str(info.has_external).lower()}"


#: Kilobytes of the units, in any case; none is kB. Bytes must make whole kilobytes.
_UNITS = {"": 1, "kb": 1, "mb": 1 << 10, "gb": 1 << 20, "tb": 1 << 30}
_SIZE = re.compile(r"\s*(\d+)\s*([A-Za-z]{0,2})\s*")


def parse_size(text: str) -> tuple[int, str]:
    """Bytes and canonical form of a memory limit from 1kB to 32GB: a whole number and a unit (kB if
    there is none). The canonical form has the largest unit that gives a whole number."""
    m = _SIZE.fullmatch(str(text))
    unit = m[2].lower() if m else None
    if unit not in (*_UNITS, "b") or (unit == "b" and int(m[1]) % 1024):
        raise HistoryError(f"invalid memory limit: {text!r}")
    kb = int(m[1]) // 1024 if unit == "b" else int(m[1]) * _UNITS[unit]
    if not 1 <= kb <= 32 << 20:
        raise HistoryError(f"memory limit out of range (1kB to 32GB): {text!r}")
    name, n = "kB", kb
    for larger in ("MB", "GB", "TB"):
        if n % 1024:
            break
        name, n = larger, n // 1024
    return kb << 10, f"{n}{name}"


# fixed values. name: (default, least, most) for numbers, (default, choices) for words, (default,) for texts and switches
SETTINGS = {
    "archive_dest": (None,), "archive_dir": (None,), "target_snapshot": (None,), "debug_log_dir": (None,),
    "memory_limit": ("1GB",), "spill_mode": ("auto", ("auto", "memory", "disk")), "parallel_workers": (8, 0, 16),
    "show_progress": (True,), "summary_service": (True,), "summary_workers": (2, 1, 8),
    "summary_scan_interval_ms": (1000, 100, 60000), "summary_queue_size": (512, 64, 4096),
    "summary_meta_limit_mb": (256, 1, 4096), "summary_meta_low_watermark_percent": (80, 25, 95),
}


def settings(**given) -> dict:
    """All settings with their defaults; unknown names and values out of range are refused."""
    out = {k: v[0] for k, v in SETTINGS.items()}
    for name, value in given.items():
        if name not in SETTINGS:
            raise HistoryError(f"unrecognized setting: {name}")
        rule = SETTINGS[name]
        if len(rule) == 3 and not (isinstance(value, int) and rule[1] <= value <= rule[2]):
            raise HistoryError(f"{name} must be from {rule[1]} to {rule[2]}")
        if len(rule) == 2:
            value = str(value).lower()
            if value not in rule[1]:
                raise HistoryError(f"{name} must be one of {', '.join(rule[1])}")
        out[name] = parse_size(value)[1] if name == "memory_limit" else value
    return out


def preflight(log_bytes: int, ops: int, updates: int, tuple_bytes: int, keyed: bool, memory_limit: str = "1GB", spill_mode: str = "auto") -> dict:
    """Estimates what a history holds besides the table. Spark spills on its own; the estimate tells
    beforehand, and in modes auto and memory refuses what passes the limit."""
    limit = parse_size(memory_limit)[0]
    estimate = log_bytes + ops * (64 + tuple_bytes) + updates * tuple_bytes + ops * (tuple_bytes + (128 if keyed else 64))
    over = estimate > limit
    if over and spill_mode == "memory":
        raise HistoryError("estimated history working set exceeds the memory limit in memory-only mode")
    if over and spill_mode == "auto":
        raise HistoryError("estimated history working set exceeds the memory limit")
    return {"estimate_bytes": estimate, "limit_bytes": limit, "spills": over}
