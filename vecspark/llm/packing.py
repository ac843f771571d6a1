"""Filling fixed-capacity containers: sum-of-squares packing.

Parts of items are spread over shards of bounded size by a hash.  Within a shard each item goes where the sum over residual gaps of the squared number of
open containers with that gap becomes smallest, which keeps gaps balanced so
that later items find a fit.  Only items above the capacity are split: their
full parts are containers of their own, the rest is packed.  What containers that
are still open at the end of their shard hold is packed again, in as many fewer
shards, so that the number of open containers does not grow with the shards.

Defined cases: null, empty and zero-size items are left out; ties go to the
smallest remaining gap, then to the container opened last; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import tokens
from vecspark.runtime import write

#: Parts of items a shard has on average; a task holds one shard.
SHARD_ITEMS = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (all sizes in 1..capacity) and their number."""
    open_ = np.zeros(capacity + 1, np.int64)  # containers by residual gap; full ones don't count
    stacks: dict[int, list[int]] = {}
    where, bins = np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            where[i], bins = bins, bins + 1
            continue
        there = open_[s:]
        # change of the sum if the item goes into a container of gap s, s + 1, ...
        cost = np.where(there > 0, 2 * (open_[: capacity - s + 1] - there) + 2, np.iinfo(np.int64).max)
        if there[0] > 0:
            cost[0] = 1 - 2 * there[0]
        cost[capacity - s] = 2 * open_[capacity - s] + 1  # a new container
        rest = int(np.argmin(cost))
        if rest == capacity - s:
            bin_, bins = bins, bins + 1
        else:
            bin_ = stacks[rest + s].pop()
            open_[rest + s] -= 1
        if rest:
            open_[rest] += 1
            stacks.setdefault(rest, []).append(bin_)
        where[i] = bin_
    return where, bins


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = 2048) -> DataFrame:
    """(id, part_no, container_id, start, size): where every part of an item
    lies; ``start`` is the part's offset within its item."""
    base = write(
        items.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")),
        "items",
    ).df
    id_type = base.schema["id"].dataType.simpleString()
    n_parts = F.ceil(F.col("n") / capacity).cast("long")
    total = base.agg(F.coalesce(F.sum(n_parts), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_ITEMS))
    parts = base.select(
        "id",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0).cast("long"), n_parts - 1),
                lambda k: F.least(F.lit(capacity).cast("long"), F.col("n") - k * capacity),
            )
        ).alias("part_no", "size"),
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part_no"], kind="stable")
        size = pdf["size"].to_numpy()
        where, bins = sum_of_squares(size, capacity)
        used = np.bincount(where, size, bins)
        return pd.DataFrame(
            {
                "id": pdf["id"],
                "part_no": pdf["part_no"],
                "container_id": (np.int64(key[1]) << np.int64(56)) + (np.int64(key[0]) << np.int64(28)) + where,
                "start": pdf["part_no"].astype("int64") * capacity,
                "size": size,
                "open": used[where] < capacity,
            }
        )

    shape = f"id {id_type}, part_no int, container_id long, start long, size long"
    columns = ["id", "part_no", "container_id", "start", "size"]
    packed = None
    for turn in range(128):
        # one task per shard: each runs a sequential loop, which AQE would merge
        sharded = parts.withColumns({
            "shard": F.pmod(F.xxhash64("id", "part_no"), F.lit(shards)).cast("int"), "turn": F.lit(turn)
        }).repartition(shards, "shard", "turn")
        out = write(sharded.groupBy("shard", "turn").applyInPandas(run, f"{shape}, open boolean"), "packed").df
        left = out.where("open")
        fewer = -(-left.count() // SHARD_ITEMS) if shards > 1 else shards
        again = fewer < shards
        done = (out.where("not open") if again else out).select(*columns)
        packed = done if packed is None else packed.unionByName(done)
        if not again:
            break
        parts, shards = left.select("id", "part_no", "size"), max(1, fewer)
    return packed


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048,
               vocabulary: str | None = None) -> DataFrame:
    """Pack texts by their number of tokens."""
    sizes = tokens.encode(df, id_col, text_col, vocabulary).select("id", F.size("ids").alias("n"))
    return pack(sizes, "id", "n", capacity)
