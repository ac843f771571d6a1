"""Time-ordered ids."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = {"point": "pt-", "document": "doc-"}


def new_id(kind: str) -> str:
    """``pt-`` or ``doc-`` and a version 7 UUID: milliseconds, then random bits."""
    if kind not in PREFIXES:
        raise ValueError(f"unknown kind of id: {kind!r}")
    value = (time.time_ns() // 1_000_000) << 80 | int.from_bytes(os.urandom(10), "big")
    value = value & ~(0xF << 76) | 7 << 76
    value = value & ~(0x3 << 62) | 2 << 62
    return PREFIXES[kind] + str(uuid.UUID(int=value))


def id_column(kind: str, millis: Column | None = None) -> Column:
    """The same as an expression; write or checkpoint the rows before using an
    id twice, as it is not the same when computed again."""
    if kind not in PREFIXES:
        raise ValueError(f"unknown kind of id: {kind!r}")
    ms = millis if millis is not None else F.unix_millis(F.current_timestamp())
    time_ = F.lpad(F.lower(F.hex(ms)), 12, "0")
    rest = F.regexp_replace(F.uuid(), "-", "")
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(rest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.lit(PREFIXES[kind]), F.substring(time_, 1, 8), F.lit("-"), F.substring(time_, 9, 4), F.lit("-7"),
        F.substring(rest, 14, 3), F.lit("-"), variant, F.substring(rest, 18, 3), F.lit("-"), F.substring(rest, 21, 12),
    )
