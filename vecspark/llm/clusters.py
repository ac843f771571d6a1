"""Grouping records into similarity clusters: distributed spherical k-means.

Records come with vectors, or get hashed weighted features of their text
(``hashed_vectors``).

Seeding is parallel and oversampled: in a few passes every row is drawn with a
probability in proportion to its distance from the seeds so far (by a hash of
its id, so that a repeated task draws the same).  The weighted seeds, bounded
in number whatever the input's size, are condensed to centres on the driver.
Each further pass assigns all rows and adds up the sums per centre on the map
side; rows too far from every centre belong to none.  Once the centres rest,
seeds are drawn again among the rows outside, until these hold no cluster.  As a
cluster holds at least ``share`` of all rows, there are at most 1 / share of them.

Defined cases: rows without a usable vector are left out; repeated rows of one
id are one; ties go to the smallest id; without any cluster (also for empty
tables) the result is empty; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm import words
from vecspark.llm.vectors import matrix, unit, unit_vectors
from vecspark.llm.words import mix
from vecspark.runtime import write

#: Expected number of seeds drawn by each pass, and the number of passes.
SEEDS, PASSES = 800, 4
#: Rows outside all clusters that are looked at for a further cluster, on average.
OUTSIDE = 4096
#: Cosine from which two centres are one.
MEET = 0.8
_ROWS = 4096
#: Hash buckets whose document frequencies weight the words of texts.
_BUCKETS = 1 << 18


def _draw(v: DataFrame, dim: int, seeds: np.ndarray, total: float, turn: int) -> tuple[np.ndarray, float]:
    """New seeds and the sum of distances to the old ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = 0.0
        for b in batches:
            x = matrix(b.column(1), dim)
            key = np.asarray(b.column(0)).view(np.uint64)
            for at in range(0, len(x), _ROWS):
                d = np.maximum(0, 1 - (x[at : at + _ROWS] @ seeds.T).max(1)).astype(np.float64)
                cost += d.sum()
                u = mix(key[at : at + _ROWS] + np.uint64(turn)) / 2.0**64
                hit = np.flatnonzero(u < SEEDS * d / max(total, 1e-9)) + at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(hit))), b.column(1).take(pa.array(hit))], ["cost", "vec"]
                )
        yield pa.RecordBatch.from_arrays([pa.array([cost]), pa.array([None], pa.binary())], ["cost", "vec"])

    rows = v.select("key", "vec").mapInArrow(run, "cost double, vec binary").collect()
    got = [np.frombuffer(r["vec"], np.float32) for r in rows if r["vec"] is not None]
    return np.array(sorted(got, key=lambda a: a.tobytes()), np.float32).reshape(-1, dim), sum(r["cost"] for r in rows)


def _sums(v: DataFrame, dim: int, centres: np.ndarray, near: float, far: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Per centre the number and the sum of the rows that belong to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres)
        n, s = np.zeros(k, np.int64), np.zeros((k, dim))
        for b in batches:
            x = matrix(b.column(0), dim)
            for at in range(0, len(x), _ROWS):
                y = x[at : at + _ROWS]
                own, ok = _belongs(y, centres, near, far)
                own, y = own[ok], y[ok]
                n += np.bincount(own, minlength=k)
                one = np.zeros((k, len(y)), np.float32)
                one[own, np.arange(len(y))] = 1
                s += one @ y
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), pa.array(n[has]), *(pa.array(s[has, j]) for j in range(dim))],
            ["k", "n", *(f"s{j}" for j in range(dim))],
        )

    schema = "k int, n long, " + ", ".join(f"s{j} double" for j in range(dim))
    rows = (
        v.select("vec").mapInArrow(run, schema).groupBy("k")
        .agg(F.sum("n").alias("n"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(dim))).collect()
    )
    n, s = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim))
    for r in rows:
        n[r["k"]], s[r["k"]] = r["n"], list(r)[2:]
    return n, s


def _belongs(x: np.ndarray, centres: np.ndarray, near: float, far: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Closest centre of each row, and whether the row belongs to it: cosine
    of ``near`` or more, and below ``far`` with any other."""
    c = x @ centres.T
    own = c.argmax(1)
    rows = np.arange(len(x))
    ok = c[rows, own] >= near
    if far is not None and len(centres) > 1:
        c[rows, own] = -2
        ok &= c.max(1) < far
    return own, ok


def _condense(seeds: np.ndarray, weight: np.ndarray, limit: int, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of a bounded number of weighted seeds, and the weight around
    each: each seed climbs to the weighted mean of its surroundings, which
    shrink until they leave out what is ``far`` (of other clusters); ends that
    meet are one."""
    top = seeds.copy()
    for radius in np.minimum([0.3, 0.35, 0.4, 0.45, 0.5, 0.5, 0.5, 0.5], far):
        near = np.where(top @ seeds.T >= radius, weight[None], 0).astype(np.float32)
        top = unit(near @ seeds).astype(np.float32)
    mass = np.where(top @ seeds.T >= far, weight[None], 0).sum(1)
    chosen: list[int] = []
    for i in np.argsort(-mass, kind="stable"):
        if not chosen or (top[chosen] @ top[i]).max() < MEET:
            chosen.append(int(i))
        if len(chosen) == limit:
            break
    return top[chosen], mass[chosen]


def _refine(v: DataFrame, dim: int, centres: np.ndarray, near: float, far: float, floor: float, least: int) -> tuple[np.ndarray, int]:
    """k-means passes until the centres rest, and the rows in their clusters.
    The first two passes are lax, as centres of strays and halves of clusters
    must not keep others from their rows."""
    inside = 0
    for turn in range(12):
        if not len(centres):
            break
        strict = turn >= 2
        size, s = _sums(v, dim, centres, near if strict else near - 0.1, far if strict else None)
        inside = int(size.sum())
        keep = np.flatnonzero(size >= (floor if turn >= 4 else max(least, floor / 4)))
        moved = unit(s[keep]).astype(np.float32)
        merged: list[int] = []
        for i in np.argsort(-size[keep], kind="stable"):
            if not merged or (moved[merged] @ moved[i]).max() < MEET:
                merged.append(int(i))
        merged.sort()
        still = len(merged) == len(centres)
        new = moved[merged]
        done = strict and turn >= 5 and still and (np.einsum("ij,ij->i", new, centres) > 1 - 1e-6).all()
        centres = new
        if done:
            break
    return centres, inside


def _outside(v: DataFrame, dim: int, centres: np.ndarray, near: float, count: int, turn: int) -> np.ndarray:
    """About OUTSIDE of the ``count`` rows that no centre is near, by hash."""
    share = min(1.0, OUTSIDE / max(count, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            drawn = mix(np.asarray(b.column(0)).view(np.uint64) + np.uint64(101 + turn)) / 2.0**64 < share
            hit = np.flatnonzero(drawn)
            if len(centres):
                hit = hit[(x[hit] @ centres.T).max(1) < near]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(hit))], ["vec"])

    got = [np.frombuffer(r["vec"], np.float32) for r in v.select("key", "vec").mapInArrow(run, "vec binary").collect()]
    return np.array(sorted(got, key=lambda a: a.tobytes()), np.float32).reshape(-1, dim)


def fit(v: DataFrame, dim: int, near: float, far: float, share: float, least: int) -> tuple[np.ndarray, int]:
    """Mean directions of all clusters of (key, vec), and the number of rows."""
    n = v.count()
    if not n:
        return np.empty((0, dim), np.float32), 0
    first = v.orderBy("key").select("vec").limit(1).collect()
    seeds, total = np.frombuffer(first[0]["vec"], np.float32).reshape(1, dim), float(n)
    for turn in range(PASSES):
        new, total = _draw(v, dim, seeds, total, turn)
        if len(new):
            seeds = np.concatenate([seeds, new])
    weight, _ = _sums(v, dim, seeds, -2.0, None)
    floor = max(least, share * n)
    # twice as many centres as there can be clusters: the rest catches strays
    start, _ = _condense(seeds, weight, int(2 / share), far)
    centres, inside = _refine(v, dim, start, near, far, floor, least)
    # seed again among the rows outside, until they hold no cluster any more
    turn = 0
    while n - inside >= floor:
        out = _outside(v, dim, centres, near, n - inside, turn)
        if not len(out):
            break
        tops, mass = _condense(out, np.full(len(out), (n - inside) / len(out), np.float32), int(2 / share), far)
        tops = tops[mass >= floor / 2]
        if not len(tops):
            break
        more, held = _refine(v, dim, np.concatenate([centres, tops]), near, far, floor, least)
        if len(more) <= len(centres):
            break
        centres, inside, turn = more, held, turn + 1
    return centres, n


def _members(v: DataFrame, keep: list[str], dim: int, centres: np.ndarray, near: float, far: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(b.num_columns - 1), dim)
            if not len(x):
                continue
            own, ok = _belongs(x, centres, near, far)
            at = np.flatnonzero(ok)
            cos = np.einsum("ij,ij->i", x[at], centres[own[at]])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(pa.array(at)) for k in range(len(keep))),
                 pa.array(own[at], pa.int32()), pa.array(cos.astype(np.float64))],
                [*keep, "k", "cosine"],
            )

    types = dict(v.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "k int", "cosine double"])
    if not len(centres):
        return v.limit(0).select(*keep, F.lit(0).alias("k"), F.lit(0.0).alias("cosine"))
    return v.select(*keep, "vec").mapInArrow(run, schema)


def cluster(df: DataFrame, id_col: str, keep: list[str], vector_col: str, dim: int = 64, near: float = 0.6,
            far: float = 0.5, share: float = 0.005, least: int = 5) -> DataFrame:
    """(id, *keep, k, cosine, cluster_id, size) of every row in a cluster;
    ``cluster_id`` is the smallest id of the cluster."""
    rows = unit_vectors(df, vector_col, [id_col, *keep], dim)
    v = write(
        rows.dropDuplicates([id_col]).select(id_col, *keep, F.xxhash64(id_col).alias("key"), "vec"), "units"
    ).df
    centres, n = fit(v, dim, near, far, share, least)
    members = write(_members(v, [id_col, *keep], dim, centres, near, far), "cluster-rows").df
    sizes = (
        members.groupBy("k").agg(F.min(id_col).alias("cluster_id"), F.count(F.lit(1)).alias("size"))
        .where(F.col("size") >= max(least, share * n))
    )
    # at most 1 / share clusters
    return members.join(F.broadcast(sizes), "k")


def found_clusters(points: DataFrame) -> DataFrame:
    """(cluster_point_id, point_id)."""
    return (
        cluster(points, "point_id", [], "embedding").where("point_id <> cluster_id")
        .select(F.col("cluster_id").alias("cluster_point_id"), "point_id")
    )


def described(points: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, size, rank_no, document_id, cosine): the members nearest
    each centre; ties by point_id.  The rank's limit is applied before the
    shuffle, so a hot cluster sends a few rows per task."""
    got = cluster(points, "point_id", ["document_id"], "embedding")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cosine"), "point_id")
    return (
        got.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= typical)
        .select("cluster_id", "size", "rank_no", "document_id", F.round("cosine", 4).alias("cosine"))
    )


def hashed_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, embedding): hashed weighted features of texts that have no vectors.

    A word's weight is its damped frequency times the inverse document
    frequency of its hash bucket, counted over all texts (``_BUCKETS`` counts,
    a bounded table); the words are added up under signed hashes.  Null texts
    are left out; texts without words get a zero vector.
    """
    base = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shift = np.uint64(64 - _BUCKETS.bit_length() + 1)

    def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, hash, frequency) of each text's distinct words."""
        w = words.read(texts)
        pairs = np.stack([np.repeat(np.arange(len(texts)), w.counts).astype(np.uint64), w.words], 1)
        once, n = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.empty(0, int))
        return once[:, 0].astype(np.int64), (once[:, 1] >> shift).astype(np.int64), once[:, 1], n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(_BUCKETS, np.int64), 0
        for b in batches:
            row, bucket, _, _ = terms(b.column(0).to_pylist())
            total += np.bincount(np.unique(row * _BUCKETS + bucket) % _BUCKETS, minlength=_BUCKETS)
            docs += b.num_rows
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(has, -1)), pa.array(np.append(total[has], docs))], ["bucket", "n"]
        )

    counted = base.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r["bucket"]: r["n"] for r in counted}
    docs = seen.pop(-1, 0)
    idf = np.full(_BUCKETS, np.log(docs + 1.0))
    for k, n in seen.items():
        idf[k] = np.log((docs + 1.0) / (n + 1.0)) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, bucket, h, n = terms(b.column(1).to_pylist())
            v = np.zeros((b.num_rows, dim))
            sign = np.where(mix(h + np.uint64(9)) >> np.uint64(63), 1.0, -1.0)
            np.add.at(v, (row, (mix(h) % np.uint64(dim)).astype(np.int64)), sign * (1 + np.log(n)) * idf[bucket])
            flat = pa.array(unit(v).astype(np.float32).reshape(-1))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "embedding"])

    id_type = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {id_type}, embedding array<float>")
