"""Deduplicating new batches against all history: incremental record linkage.

History is kept in a folder that outlives the session, as versioned tables (see
``sources.store``): profiles, which hold per record its class of copies and its
form; blocking keys of classes (see ``near``), parted by BUCKETS of keys; the
texts of accepted arrivals; representatives.  ``History.build`` profiles a store
once, ``History.open`` takes the folder up again.  A batch brings its own keys and
probes the buckets that these fall into; a bitmap of its keys leaves all others
behind in the scan, and only texts of classes that meet are read again and
compared.  ``History.append`` adds what was accepted, so that the next batch meets
it.  Which arrivals are accepted is settled in rounds: an arrival without an
undecided or accepted earlier partner is accepted, its later partners are not.

Representatives are a union-find mapping: the links of a batch join the clusters
that they touch, and only these are written again.  A cluster's representative is
a record of the store (the smallest id) or else its first accepted arrival.

Scores: features of each link (similarity of texts, equal hash, name, source,
closeness of length) are weighted by a logistic model, fitted to at most SAMPLE
candidate pairs, half of them links and half candidates that the exact comparison
rejects; the score picks the best among several accepted partners, it never drops
a pair.

Defined cases: null and blank contents are neither linked nor accepted; rows
that repeat are one arrival; a null batch_no or seq_no comes last, ties go by
id; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark import runtime
from vecspark.llm import near
from vecspark.llm.components import components
from vecspark.runtime import Written, join_salted, maybe_in, strip, write
from vecspark.sources.store import Store

#: Labelled candidate pairs that the weights are fitted to, at most.
SAMPLE = 20_000
#: Keys of a bucket on average, and buckets at most.
BUCKET, BUCKETS = 1 << 18, 4096
#: A call of ``found_links`` takes whole batches until they have so many rows,
#: or this share of the history's, whichever is more.
CALL_ROWS, CALL_SHARE = 1000, 0.1
FEATURES = ("similarity", "same_md5", "same_name", "same_source", "length_ratio")


def _usable(df: DataFrame, text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull() & (strip(F.col(text_col)) != ""))


_TABLES = {
    # rank: the record's name in clusters, smaller for those that represent
    "profiles": "id string, cls long, in_order long, as_card long, rank string",
    "keys": "key long, cls long, bucket int",
    "records": "document_id string, name string, content string, content_md5 string, source_id string",
    "representatives": "node string, component string, version long",
}
_STORED, _ARRIVED, _REFUSED = "0", "1", "2"


class History:
    """Accepted records, below a folder: their profiles and keys, the texts of
    accepted arrivals and the representatives of all that was linked.

    ``store`` is the table the history was built of; its texts stay there, and
    rows that it gets later count only if they come as arrivals.
    """

    def __init__(self, store: DataFrame, path: str):
        self.spark = store.sparkSession
        self._store, self._state = store, Store(self.spark, path)

    @classmethod
    def build(cls, store: DataFrame, path: str | None = None) -> History:
        """Profile a store; without ``path`` for this session only."""
        if path is None:
            path = f"{runtime.shared_dir(store.sparkSession)}/history-{uuid.uuid4().hex}"
            runtime._WRITTEN.append(Written(store.sparkSession, path, None))
        history = cls(store, path)
        if history.version:
            raise ValueError(f"{path} holds a history already")
        profiles = write(near.profile(_usable(store, "content"), "document_id", "content", forms=True), "history-profiles")
        rows = profiles.df
        n = rows.agg(F.coalesce(F.sum(F.greatest(F.size("keys"), F.lit(0))), F.lit(0))).first()[0]
        buckets = 8
        while buckets < BUCKETS and buckets * BUCKET < n:
            buckets *= 2
        keys = rows.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "cls")
        history._commit(0, {
            "profiles": rows.drop("keys").withColumn("rank", F.concat(F.lit(_STORED), "id")),
            "keys": keys.withColumn("bucket", _bucket(buckets)),
        }, buckets)
        profiles.drop()
        return history

    @classmethod
    def open(cls, store: DataFrame, path: str) -> History:
        """The history that was built below ``path``; profiles nothing."""
        history = cls(store, path)
        if not history.version:
            raise ValueError(f"{path} holds no history")
        return history

    @property
    def version(self) -> int:
        return self._state.state()[0]

    @property
    def buckets(self) -> int:
        return self._state.state()[1]["buckets"]

    def _read(self, table: str) -> DataFrame:
        parts = self._state.state()[1].get(table, [])
        if not parts:
            return self.spark.createDataFrame([], _TABLES[table])
        # a part's folders of buckets are its own
        read = self.spark.read.schema(_TABLES[table])
        frames = [read.option("basePath", f"{self._state.root}/{p}").parquet(f"{self._state.root}/{p}") for p in parts] if (
            table == "keys") else [read.parquet(*(f"{self._state.root}/{p}" for p in parts))]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _commit(self, version: int, rows: Mapping[str, DataFrame], buckets: int) -> None:
        """Add rows to tables as the version after ``version``; fails if that exists."""
        tables = self._state.state()[1]
        for table, df in rows.items():
            part = f"{table}/part-{version + 1:010d}-{uuid.uuid4().hex}"
            if table == "keys":
                df.repartition("bucket").write.partitionBy("bucket").parquet(f"{self._state.root}/{part}")
                self._state.ensure(part)
            else:
                df.write.parquet(f"{self._state.root}/{part}")
            tables[table] = [*tables.get(table, []), part]
        tables["buckets"] = buckets
        self._state._publish(version + 1, tables)

    @property
    def profiles(self) -> DataFrame:
        return self._read("profiles")

    def probe(self, keys: DataFrame) -> tuple[DataFrame, float]:
        """(key, cls) of the classes that have one of ``keys``, and the share
        of buckets that was read for it."""
        n = self.buckets
        used = [r[0] for r in keys.select(_bucket(n).alias("b")).distinct().collect()]  # BUCKETS at most
        rows = self._read("keys")
        if len(used) < n:
            rows = rows.where(F.col("bucket").isin(used) if used else F.lit(False))
        met = maybe_in(rows.select("key", "cls"), keys, "key").join(keys.select("key").distinct(), "key")
        return write(met.distinct(), "probed").df, len(used) / n

    def table(self, *cols: str) -> DataFrame:
        """These columns of all accepted records."""
        return _usable(self._store, "content").select(*cols).unionByName(self._read("records").select(*cols))

    def clusters(self) -> DataFrame:
        """(node, component): ranks of all that was linked, and the smallest of
        their cluster."""
        return self._read("representatives").groupBy("node").agg(F.max_by("component", "version").alias("component"))

    def representatives(self) -> DataFrame:
        """(id, representative_id) of all that was linked."""
        return self.clusters().select(_id_of("node").alias("id"), _id_of("component").alias("representative_id"))

    def append(self, linked: Linked, batch: DataFrame) -> None:
        """Add the accepted arrivals of ``batch`` and its links.  An error if
        the history has changed since it was linked."""
        records = _usable(batch, "content").join(
            linked.accepted.select(F.col("id").alias("document_id")), "document_id", "left_semi"
        ).dropDuplicates(["document_id"])
        known = self.clusters()
        edges = linked.pairs.where("in_id <> accepted_id").select(F.concat(F.lit(_REFUSED), "in_id").alias("x"), F.col("rank").alias("y"))
        edges = write(edges.distinct(), "history-links").df
        nodes = edges.select(F.col("x").alias("node")).unionByName(edges.select(F.col("y").alias("node")))
        # the clusters that links touch, by their names
        met = known.join(nodes.distinct(), "node", "left_semi")
        joined = write(components(edges.unionByName(met.toDF("x", "y")), "x", "y"), "history-joined").df
        others = known.join(joined.select(F.col("node").alias("component"), F.col("component").alias("new")), "component")
        changed = (
            joined.unionByName(others.select("node", F.col("new").alias("component"))).distinct()
            .join(known, ["node", "component"], "left_anti")
        )
        buckets = self.buckets
        self._commit(linked.version, {
            "profiles": linked.profiles,
            "keys": linked.keys.withColumn("bucket", _bucket(buckets)),
            "records": records.select(*(F.col(c).cast("string") for c in ("document_id", "name", "content", "content_md5", "source_id"))),
            "representatives": changed.withColumn("version", F.lit(linked.version + 1).cast("long")),
        }, buckets)


def _bucket(n: int) -> Column:
    return F.pmod("key", F.lit(n)).cast("int")


def _id_of(rank: str) -> Column:
    """The id in a rank: arrivals that were accepted carry their order, too."""
    c = F.col(rank)
    return F.when(c.startswith(_ARRIVED), F.substring(c, 42, 1 << 30)).otherwise(F.substring(c, 2, 1 << 30))


def _arrived(order: str) -> Column:
    """The rank of an accepted arrival: its order in 20 digits a number, its id."""
    number = [F.lpad((F.col(f"{order}.{c}").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0") for c in "bs"]
    return F.concat(F.lit(_ARRIVED), *number, F.col(f"{order}.i"))


class Linked:
    """The result of linking a batch.

    ``pairs``: (in_id, ord, accepted_id, rank, similarity, same_form), one per
    arrival and accepted record; ``accepted``: ids of arrivals that became
    records; ``profiles``, ``keys``: theirs; ``version``: the history's that was
    probed, ``read``: the share of its buckets that were; ``rejected``: like
    ``pairs``, of a bounded sample of candidates that are no links, one row per
    two classes.
    """

    def __init__(self, pairs: DataFrame, accepted: DataFrame, profiles: DataFrame, keys: DataFrame, version: int, read: float,
                 rejected: DataFrame):
        self.pairs, self.accepted, self.profiles, self.keys = pairs, accepted, profiles, keys
        self.version, self.read, self.rejected = version, read, rejected


def link(history: History, batch: DataFrame, threshold: float = 0.6) -> Linked:
    """Link the rows of ``batch`` (one batch or many) to the history and to
    earlier accepted arrivals."""
    arrivals = _usable(batch, "content")
    profiled = near.profile(
        arrivals.withColumn("_id", F.to_json(F.struct(
            F.col("document_id").alias("i"), F.col("batch_no").cast("long").alias("b"), F.col("seq_no").cast("long").alias("s")
        ))), "_id", "content", forms=True,
    )
    last = F.lit((1 << 63) - 1)
    mine = write(
        profiled.withColumn("_k", F.from_json("id", "i string, b long, s long")).select(
            F.col("_k.i").alias("id"),
            # the order of arrival; without a number, last; ties by id
            F.struct(F.coalesce("_k.b", last).alias("b"), F.coalesce("_k.s", last).alias("s"), F.col("_k.i").alias("i")).alias("ord"),
            "cls", "in_order", "as_card", "keys",
        ),
        "arrivals",
    ).df
    version, theirs = history.version, history.profiles

    # candidates: arrivals' keys meet the history's and each other
    own_keys = write(near.key_rows(mine), "arrival-keys").df
    hits, read = history.probe(own_keys)
    sources = [
        (theirs, history.table("document_id", "content"), "document_id", "content"),
        (mine.select("id", "cls", "in_order", "as_card"), arrivals, "document_id", "content"),
    ]
    keys = hits.withColumn("new", F.lit(False)).unionByName(own_keys.withColumn("new", F.lit(True)))
    pairs = write(near.block_pairs(keys, sources, threshold), "link-pairs").df
    sets = near.class_sets(pairs, sources)
    held = write(near.verified(pairs, sets, threshold, True), "links").df
    # classes of copies are the same form, whatever their similarity
    edges = held.select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y"), "similarity", "same_form")
    edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity", "same_form"))
    own = mine.select("cls").distinct()
    equal = own.select(F.col("cls").alias("x"), F.col("cls").alias("y"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same_form"))
    edges = edges.unionByName(equal).join(own.select(F.col("cls").alias("x")), "x", "left_semi")

    to_old = edges.join(hits.select(F.col("cls").alias("y")).distinct(), "y", "left_semi").select("x", "y", "similarity", "same_form")
    to_old = write(to_old, "links-old").df
    rows = mine.select("id", "ord", "cls").distinct()  # rows that repeat are one arrival
    matched = to_old.select(F.col("x").alias("cls")).distinct()
    free = write(
        rows.join(matched, "cls", "left_anti").groupBy("cls").agg(F.min("ord").alias("ord")), "free-classes"
    ).df
    accepted_cls = _settle(free, held)
    accepted = write(
        rows.join(accepted_cls, ["cls", "ord"]).select("id", "ord", "cls"), "accepted"
    ).df

    shown = ("in_id", "ord", "accepted_id", "rank", "similarity", "same_form")
    before = theirs.select(F.col("id").alias("accepted_id"), F.col("rank"), F.col("cls").alias("y"))
    linked = to_old.select("y").distinct()
    old = write(maybe_in(before, linked, "y").join(linked, "y").select(*before.columns).distinct(), "linked-records").df
    arrived = rows.select(F.col("id").alias("in_id"), "ord", F.col("cls").alias("x"))
    n_rows, n_old = rows.count(), old.count()
    a = join_salted(join_salted(to_old, old, "y", "accepted_id", n_old), arrived, "x", "in_id", n_rows).select(*shown)
    new = accepted.select(
        F.col("id").alias("accepted_id"), _arrived("ord").alias("rank"), F.col("ord").alias("acc_ord"), F.col("cls").alias("y")
    )
    b = join_salted(edges.join(new, "y"), arrived, "x", "in_id", n_rows).where("ord > acc_ord").select(*shown)
    profiles = (
        accepted.select("id", "cls", _arrived("ord").alias("rank")).distinct()
        .join(mine.select("cls", "in_order", "as_card").dropDuplicates(["cls"]), "cls")
        .select("id", "cls", "in_order", "as_card", "rank")
    )
    new_keys = own_keys.join(accepted.select("cls").distinct(), "cls", "left_semi").select("key", "cls")
    records = before.unionByName(new.select("accepted_id", "rank", "y"))
    rejected = _rejected(pairs, held, sets, rows, records)
    return Linked(a.unionByName(b), accepted.select("id", "ord"), profiles, new_keys, version, read, rejected)


def _rejected(pairs: DataFrame, held: DataFrame, sets: DataFrame, rows: DataFrame, records: DataFrame) -> DataFrame:
    """(in_id, ord, accepted_id, rank, similarity, same_form) of the SAMPLE candidate
    pairs of classes with the smallest hashes that do not hold."""
    some = pairs.join(held.select("cls_a", "cls_b"), ["cls_a", "cls_b"], "left_anti").orderBy(
        F.xxhash64("cls_a", "cls_b"), "cls_a", "cls_b"
    ).limit(SAMPLE)
    known = near.similarities(some, sets).select(F.col("cls_a").alias("x"), F.col("cls_b").alias("y"), "similarity")
    known = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"), "similarity"))
    left = rows.groupBy(F.col("cls").alias("x")).agg(F.min(F.struct("ord", "id")).alias("l"))
    met = known.select("y").distinct()
    right = maybe_in(records, met, "y").join(met, "y").groupBy("y").agg(F.min(F.struct("accepted_id", "rank")).alias("r"))
    return known.join(left, "x").join(right, "y").select(
        F.col("l.id").alias("in_id"), F.col("l.ord").alias("ord"), F.col("r.accepted_id").alias("accepted_id"), F.col("r.rank").alias("rank"),
        "similarity", F.lit(False).alias("same_form"),
    )


def _settle(free: DataFrame, held: DataFrame) -> DataFrame:
    """(cls, ord) of the accepted classes' first arrivals: in the order of
    arrival, each that has no accepted partner before it."""
    x = free.select(F.col("cls").alias("cls_a"), F.col("ord").alias("ord_a"))
    y = free.select(F.col("cls").alias("cls_b"), F.col("ord").alias("ord_b"))
    live = (
        held.select("cls_a", "cls_b").join(x, "cls_a").join(y, "cls_b")
        .select(
            F.when(F.col("ord_a") < F.col("ord_b"), F.col("cls_a")).otherwise(F.col("cls_b")).alias("early"),
            F.when(F.col("ord_a") < F.col("ord_b"), F.col("cls_b")).otherwise(F.col("cls_a")).alias("late"),
        )
    )
    live = write(live, "open-links").df
    refused = None
    while live.limit(1).count():
        # accepted: an early end that is nobody's late end
        sure = live.select(F.col("early").alias("cls")).distinct().join(
            live.select(F.col("late").alias("cls")).distinct(), "cls", "left_anti"
        )
        out = write(
            live.join(sure.withColumnRenamed("cls", "early"), "early", "left_semi")
            .select(F.col("late").alias("cls")).distinct(),
            "refused",
        ).df
        refused = out if refused is None else refused.unionByName(out)
        live = write(
            live.join(out.withColumnRenamed("cls", "early"), "early", "left_anti")
            .join(out.withColumnRenamed("cls", "late"), "late", "left_anti"),
            "open-links",
        ).df
    return free if refused is None else free.join(refused, "cls", "left_anti")


def calls(batches: DataFrame, history: History) -> Iterator[DataFrame]:
    """``batches`` in their order, as many whole ones at a time as make up
    CALL_ROWS rows or CALL_SHARE of the history, whichever is more."""
    size = max(CALL_ROWS, int(CALL_SHARE * history.profiles.count()))
    n = F.coalesce(F.col("batch_no").cast("long"), F.lit((1 << 63) - 1))
    # one row per batch and, at last, one row per call
    counts = batches.select(n.alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    call = F.floor(F.coalesce(upto, F.lit(0)) / F.lit(size)).alias("call")
    ends = [r["n"] for r in counts.select("n", call).groupBy("call").agg(F.max("n").alias("n")).orderBy("call").collect()]
    low = None
    for end in ends:
        yield batches.where((n <= end) if low is None else (n > low) & (n <= end))
        low = end


def _linked(batches: DataFrame, store: DataFrame, threshold: float, history: History | None) -> Iterator[tuple[Linked, DataFrame, History]]:
    """Link and append call by call; the last call is appended only to a
    history that outlives this."""
    kept = history
    history = history or History.build(store)
    todo = list(calls(batches, history))
    for i, part in enumerate(todo):
        linked = link(history, part, threshold)
        # a record that arrives again is no partner of itself
        linked.pairs = write(linked.pairs.where("in_id <> accepted_id"), "link-rows").df
        if kept or i + 1 < len(todo):
            history.append(linked, part)
        yield linked, part, history


def found_links(batches: DataFrame, store: DataFrame, threshold: float = 0.6, history: History | None = None) -> DataFrame:
    """(document_id_a, document_id_b) of every arrival and accepted record.
    ``history``: of the store and earlier calls; these batches are added to it."""
    got = None
    for linked, _, _ in _linked(batches, store, threshold, history):
        got = linked.pairs if got is None else got.unionByName(linked.pairs)
    if got is None:
        return store.sparkSession.createDataFrame([], "document_id_a string, document_id_b string")
    return got.select(
        F.least("in_id", "accepted_id").alias("document_id_a"),
        F.greatest("in_id", "accepted_id").alias("document_id_b"),
    )


def _features(pairs: DataFrame, batch: DataFrame, records: DataFrame) -> DataFrame:
    cols = ("name", "content_md5", "source_id")
    fields = [F.lower(F.trim(F.col(c))).alias(c) for c in cols] + [F.length("content").alias("size")]
    left = batch.select(F.col("document_id").alias("in_id"), *fields)
    right = records.select(F.col("document_id").alias("accepted_id"), *fields)
    for c in (*cols, "size"):
        left, right = left.withColumnRenamed(c, f"l_{c}"), right.withColumnRenamed(c, f"r_{c}")
    left, right = left.dropDuplicates(["in_id"]), right.dropDuplicates(["accepted_id"])
    both = pairs.join(left, "in_id").join(right, "accepted_id")

    def same(c: str) -> Column:
        return F.coalesce((F.col(f"l_{c}") == F.col(f"r_{c}")).cast("double"), F.lit(0.0))

    ratio = F.least("l_size", "r_size") / F.greatest("l_size", "r_size", F.lit(1))
    return both.select(
        "in_id", "ord", "accepted_id", "similarity", "same_form",
        same("content_md5").alias("same_md5"), same("name").alias("same_name"),
        same("source_id").alias("same_source"), F.coalesce(ratio, F.lit(0.0)).alias("length_ratio"),
    )


def fit_weights(links: DataFrame, rejected: DataFrame) -> np.ndarray:
    """Logistic weights (intercept last) of FEATURES, links against rejected
    candidates; of each those with the SAMPLE / 2 smallest hashes of their ids."""
    rows = [
        r for df, y in ((links, 1.0), (rejected, 0.0))
        for r in df.orderBy(F.xxhash64("in_id", "accepted_id"), "in_id", "accepted_id").limit(SAMPLE // 2)
        .select(*(F.col(c).cast("double") for c in FEATURES), F.lit(y).alias("y")).collect()
    ]
    w = np.zeros(len(FEATURES) + 1)
    if not rows:
        return w
    x = np.array([list(r)[:-1] + [1.0] for r in rows])
    y = np.array([r["y"] for r in rows])
    ridge = np.eye(len(w)) * 1.0
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(weights: np.ndarray) -> Column:
    """The probability of a link by its FEATURES."""
    z = F.lit(float(weights[-1]))
    for c, k in zip(FEATURES, weights):
        z = z + F.col(c) * F.lit(float(k))
    return 1 / (1 + F.exp(-z))


def representatives(batches: DataFrame, store: DataFrame, threshold: float = 0.6,
                    history: History | None = None) -> DataFrame:
    """(document_id, representative_id, best_id, score) of each arrival that
    repeats an accepted record: the representative of the cluster that its links
    join, and the partner of the highest score.  ``history``: of the store and
    earlier calls; these batches are added to it."""
    history = history or History.build(store)
    feats = rejected = None
    for linked, part, _ in _linked(batches, store, threshold, history):
        records = history.table("document_id", "name", "content", "content_md5", "source_id")
        own = write(_features(linked.pairs, part, records), "link-features").df
        no = write(_features(linked.rejected, part, records), "link-rejected").df
        feats = own if feats is None else feats.unionByName(own)
        rejected = no if rejected is None else rejected.unionByName(no)
    if feats is None:
        return store.sparkSession.createDataFrame([], "document_id string, representative_id string, best_id string, score double")
    scored = feats.withColumn("score", F.round(score(fit_weights(feats, rejected)), 6))
    best = scored.groupBy(F.col("in_id").alias("document_id")).agg(
        # highest score, then the smallest id
        F.min(F.struct((-F.col("score")).alias("s"), F.col("accepted_id").alias("i"))).alias("b")
    )
    return best.join(history.representatives().withColumnRenamed("id", "document_id"), "document_id").select(
        "document_id", "representative_id", F.col("b.i").alias("best_id"), (-F.col("b.s")).alias("score"),
    )
