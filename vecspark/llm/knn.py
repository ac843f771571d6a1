"""Most similar vectors for every vector: an inverted index of lists with an
adaptive dimension scan.

Index: centres are fitted on a bounded sample (``SAMPLE`` vectors by hash); every
vector goes into the list of its nearest centre and probes all lists whose border
with its own is within ``REACH``, however many these are: no vector with a cosine
of at least ``SURE`` lies in another list.  Where these lists hold few members, it
probes the next ones, too, until they hold enough.  Neighbouring lists form groups; a
vector is sent once to a group, not once to each list of it that it probes.

Vectors are rotated at random, so that any block of dimensions estimates the
whole distance.  A query scans the list of its nearest centre first, which bounds
the distance of its k-th best, then the others that it probes.  In a list the
first block of dimensions is compared with all members, each further one only
with the candidates of that very query that no hypothesis test has abandoned:
those whose partial distance lets the whole be below the bound, or be that of a
cosine of SURE, where the test is far stricter.  Long groups are cut into tiles,
so a task holds a bounded number of members and queries.

Who wants only neighbours from some cosine on (``found_pairs``) gets them from
``Close``: borders and angles to centres leave the lists that can hold one, the
first block of dimensions is tested against the wanted distance, as strictly as
for SURE, and no other neighbour is looked for.

Equal vectors are one entry of the index; a group of copies, however large, is
expanded only in the final pairs.

Defined cases: unusable vectors are left out; repeated rows of one id are one
point; ties go to the smaller hash of the vector, among copies to the smaller
id; fewer than k others give fewer neighbours; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm.vectors import binary, matrix, spherical_kmeans, unit_vectors
from vecspark.llm.words import mix
from vecspark.runtime import write

#: Vectors that the centres are fitted to, at most, and members per list aimed at.
SAMPLE, LIST = 32_768, 1_024
#: Lists per group, on average.
GROUP = 8
#: Cosine from which no neighbour is missed for the lists' sake: one in another
#: list is at most acos(SURE) away, so the border between both lists is, too.
SURE = 0.95
REACH = (1 - SURE * SURE) ** 0.5
#: Members and queries of a tile at most, on average.
TILE, ASKING = 16_384, 40_960
#: Members of a part of a group of ``Close`` at most, on average.
PART = 262_144
#: Queries and members compared at a time, and members that give a query without
#: any bound its first one.
_QUERIES, _MEMBERS, _FIRST = 512, 1024, 256
#: Where blocks of dimensions end, as shares of all.
ENDS = (0.375, 0.625, 1.0)
#: Standard deviations of an estimated distance that the test allows for against
#: the bound, and against the distance of SURE.
EPS, EPS_SURE = 0.8, 3.0


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.RandomState(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _merge(best: np.ndarray, score: np.ndarray, rows: np.ndarray, names: np.ndarray, values: np.ndarray) -> None:
    """Put candidates of ``rows`` (sorted) among their k best; ties by name."""
    k = best.shape[1]
    own, start = np.unique(rows, return_index=True)
    n = np.diff(np.append(start, len(rows))) + k
    q = np.concatenate([np.repeat(own, k), rows])
    i = np.concatenate([best[own].reshape(-1), names])
    v = np.concatenate([score[own].reshape(-1), values])
    order = np.lexsort((i, -v, q))
    take = (np.cumsum(n) - n)[:, None] + np.arange(k)
    best[own], score[own] = i[order][take], v[order][take]


class Members:
    """Rotated unit vectors of a list, cut into blocks of dimensions, and the
    ``names`` that results call them by."""

    def __init__(self, vectors: np.ndarray, names: np.ndarray):
        self.vectors, self.names, self.dim = vectors, names, vectors.shape[1]
        self.ends = [round(e * self.dim) for e in ENDS]
        self.blocks, self.norms = self.cut(vectors)
        one = np.ones((len(vectors), 1), np.float32)
        self.first = np.ascontiguousarray(np.concatenate([self.blocks[0], one, -self.norms[0][:, None] / 2], 1).T)

    def cut(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Blocks of dimensions, and the squared norms up to each block's end."""
        blocks = [np.ascontiguousarray(x[:, a:b]) for a, b in zip([0, *self.ends], self.ends)]
        return blocks, list(np.cumsum([np.einsum("ij,ij->i", b, b) for b in blocks], 0, dtype=np.float32))

    def limit(self, bound: np.ndarray, turn: int) -> np.ndarray:
        """Partial squared distance up to which a candidate is not abandoned."""
        done = self.ends[turn]
        near = (2 - 2 * bound) * (1 + EPS / done**0.5) ** 2
        return done / self.dim * np.maximum(near, (2 - 2 * SURE) * (1 + EPS_SURE / done**0.5) ** 2)


def scan(queries: np.ndarray, members: Members, own: np.ndarray, best: np.ndarray, score: np.ndarray) -> tuple[int, int]:
    """Bring ``best`` (names, -1 where there are fewer) and ``score`` (cosines)
    of each query up to date with a list.  ``own``: the name that does not count
    for each query.  Returns the multiplications done, and those of a full scan."""
    m, k, count = members, best.shape[1], len(members.vectors)
    done, whole = 0, len(queries) * count * m.dim
    for a in range(0, len(queries), _QUERIES):
        x, mine, b, s = (c[a : a + _QUERIES] for c in (queries, own, best, score))
        n, at = len(x), 0
        if (s[:, -1] <= -2).any():  # nothing to compare with yet
            at = min(_FIRST, count)
            d = x @ m.vectors[:at].T
            d[m.names[None, :at] == mine[:, None]] = -2
            done += d.size * m.dim
            top = np.argpartition(d, at - min(k, at), axis=1)[:, at - min(k, at) :]
            v = np.take_along_axis(d, top, 1).reshape(-1)
            rows, names = np.repeat(np.arange(n), top.shape[1]), m.names[top.reshape(-1)]
            ok = v > -2
            _merge(b, s, rows[ok], names[ok], v[ok])
        blocks, norms = m.cut(x)
        for m0 in range(at, count, _MEMBERS):
            m1, bound = min(m0 + _MEMBERS, count), s[:, -1].copy()
            # the test of the first block is part of its product: a value above
            # zero is a partial distance within the limit
            margin = (m.limit(bound, 0) - norms[0]) / 2
            first = np.concatenate([blocks[0], margin[:, None], np.ones((n, 1))], 1).astype(np.float32)
            d = (first @ m.first[:, m0:m1]).reshape(-1)
            done += d.size * first.shape[1]
            alive = np.flatnonzero(d > 0).astype(np.int32)  # a block holds few pairs
            q = alive // np.int32(m1 - m0)
            c = alive - q * np.int32(m1 - m0) + np.int32(m0)
            v = d[alive] - first[q, -2] + m.norms[0][c] / 2
            for turn in range(1, len(ENDS)):
                v += np.einsum("ij,ij->i", blocks[turn].take(q, 0), m.blocks[turn].take(c, 0))
                done += len(q) * blocks[turn].shape[1]
                if turn + 1 < len(ENDS):
                    ok = v - m.norms[turn][c] / 2 >= ((norms[turn] - m.limit(bound, turn)) / 2)[q]
                else:
                    ok = (v > bound[q]) & (m.names[c] != mine[q])
                q, c, v = q[ok], c[ok], v[ok]
            if len(q):
                _merge(b, s, q, m.names[c], v)
    return done, whole


def scan_lists(x: np.ndarray, lists: np.ndarray, home: np.ndarray, asks: np.ndarray, probes: np.ndarray,
               k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(asking rows, rows of their k best, cosines, multiplications done and
    possible) of rotated unit vectors; rows of one tile.  ``lists``: of each row
    its list's number; ``home``, ``asks``: rows that are members, and queries;
    ``probes``: a column per list, whether a row asks it, first those where it
    is highest."""
    rows = np.flatnonzero(asks)
    first = np.where(probes[rows] > 0, probes[rows], -np.inf).argmax(1) if len(rows) else rows
    best, score = np.full((len(rows), k), -1, np.int64), np.full((len(rows), k), -2.0, np.float32)
    held = [np.flatnonzero(home & (lists == i)) for i in range(probes.shape[1])]
    members = [Members(np.ascontiguousarray(x[h]), h) for h in held]
    done = whole = 0
    for nearest in (True, False):
        for i, m in enumerate(members):
            asking = (probes[rows, i] > 0) & ((first == i) == nearest)
            # those with and those without a bound are scanned apart
            for q in (np.flatnonzero(asking & (score[:, -1] > -2)), np.flatnonzero(asking & (score[:, -1] <= -2))):
                if len(q) and len(m.vectors):
                    b, s = best[q], score[q]
                    n, of = scan(np.ascontiguousarray(x[rows[q]]), m, rows[q], b, s)
                    best[q], score[q], done, whole = b, s, done + n, whole + of
    return rows, best, score, done, whole


class Lists:
    """Centres of lists (rows of a matrix), and groups of neighbouring lists."""

    def __init__(self, centres: np.ndarray, group: np.ndarray | None = None):
        self.centres = centres
        #: Members of each list, and how many the probed ones hold together at least.
        self.held, self.need = np.zeros(len(centres), np.int64), 0
        self.apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)).astype(np.float32)
        if group is None:
            middles = spherical_kmeans(centres, max(1, -(-len(centres) // GROUP)))
            group = np.unique((centres @ middles.T).argmax(1), return_inverse=True)[1]
        self.group = group
        self.order = np.argsort(group, kind="stable")
        self.starts = np.searchsorted(group[self.order], np.arange(self.groups))

    @property
    def groups(self) -> int:
        return int(self.group.max()) + 1

    def turned(self, turn: np.ndarray) -> Lists:
        out = Lists(self.centres @ turn, self.group)
        out.held, out.need = self.held, self.need
        return out

    def probed(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list that each row belongs to, how close each of ``lists`` is that it
        probes: cosine of its centre plus 2; 0 for those not probed)."""
        home = np.empty(len(x), np.int64)
        probes = np.empty((len(x), len(lists)), np.float32)
        for i in range(0, len(x), 4096):
            c = x[i : i + 4096] @ self.centres.T
            own = c.argmax(1)
            home[i : i + 4096] = own
            # the border of two lists is (own cosine - other) / |own centre - other| away
            every = c.max(1)[:, None] - c <= REACH * self.apart[own] + 1e-5
            few = np.flatnonzero(every.astype(np.float32) @ self.held.astype(np.float32) < self.need)
            if len(few):
                order = np.argsort(-c[few], axis=1, kind="stable")
                before = np.cumsum(self.held[order], 1) - self.held[order]
                at, j = np.nonzero(before < self.need)
                every[few[at], order[at, j]] = True
            probes[i : i + 4096] = np.where(every[:, lists], c[:, lists] + 2, 0)
        return home, probes

    def grouped(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, is home) of every group that rows belong to or probe."""
        home, probes = self.probed(x, self.order)
        rows, groups = np.nonzero(np.logical_or.reduceat(probes > 0, self.starts, axis=1))
        return rows, groups, self.group[home[rows]] == groups


def _listed(cls: np.ndarray, names: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """(cls, o, c) of those that have neighbours: these, best first, and their cosines."""
    n = (score > -2).sum(1)
    cls, names, score, n = (c[n > 0] for c in (cls, names, score, n))
    kept = np.arange(score.shape[1])[None] < n[:, None]
    offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (names[kept], score[kept].astype(np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(cls), *lists], ["cls", "o", "c"])


def _best(met: DataFrame, k: int) -> DataFrame:
    """(cls, others) of the results (cls, o, c) of all tasks."""
    return met.groupBy("cls").agg(
        F.slice(
            F.array_sort(F.flatten(F.collect_list(F.zip_with(
                "o", "c", lambda o, c: F.struct((-c).alias("c"), o.alias("o")))))),
            1, k,
        ).alias("others")
    )


class Index:
    """Lists of the distinct vectors (cls, vec) of a table."""

    #: Lists at most.
    MOST = SAMPLE // 16

    def __init__(self, entries: DataFrame, dim: int, n: int):
        self.entries, self.dim, self.n = entries, dim, n
        lists = max(1, min(self.MOST, -(-n // LIST)))
        size, h = min(SAMPLE, 64 * lists), F.xxhash64("cls")
        # the smallest hashes, of which only about twice as many are sorted
        some = entries.where(h < -(1 << 63) + (1 << 65) * size // n) if n > 4 * size else entries
        sample = np.array(
            [np.frombuffer(r[0], np.float32) for r in some.orderBy(h).select("vec").limit(size).collect()], np.float32
        ).reshape(-1, dim)
        self.turn = rotation(dim)
        self.lists = Lists(spherical_kmeans(sample, lists)) if len(sample) else None

    def _counts(self, k: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """How often ``of`` names each number below ``k`` (at most SAMPLE / 8)
        for the vectors, counted without moving one."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(k, np.int64)
            for b in batches:
                n += np.bincount(of(matrix(b.column(0), dim)), minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n)], ["i", "n"])

        out = np.zeros(k, np.int64)
        for r in self.entries.select("vec").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            out[r["i"]] = r["n"]
        return out

    def sizes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Members and queries of each group for ``k`` neighbours."""
        index = self.lists
        none = np.empty(0, np.int64)
        index.held = self._counts(len(index.centres), lambda x: index.probed(x, none)[0])
        index.need = max(LIST, k + 1)
        members = np.bincount(index.group, index.held, minlength=index.groups).astype(np.int64)
        return members, self._counts(index.groups, lambda x: index.grouped(x)[1])

    def tiles(self, k: int) -> DataFrame:
        """(grp, mt, qt, cls, home, asks, vec): every entry as a member of its
        group's tiles and as a query of the tiles it probes; one row where it is
        both.  ``vec`` is rotated."""
        index, turn, dim = self.lists, self.turn, self.dim
        m, q = self.sizes(k)
        cuts = np.stack([np.maximum(1, -(-m // TILE)), np.maximum(1, -(-q // ASKING))], 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), dim)
                if not len(x):
                    continue
                rows, groups, home = index.grouped(x)
                key = mix(np.asarray(b.column(0)).view(np.uint64))[rows]
                mts, qts = cuts[groups, 0], cuts[groups, 1]
                mine = (key % mts.astype(np.uint64)).astype(np.int64)
                ask = ((key >> np.uint64(32)) % qts.astype(np.uint64)).astype(np.int64)
                parts = []
                for mt in range(int(mts.max())):
                    for qt in range(int(qts.max())):
                        member = home & (mine == mt) & (qt < qts)
                        query = (ask == qt) & (mt < mts)
                        at = np.flatnonzero(member | query)
                        parts.append((at, np.full(len(at), mt), np.full(len(at), qt), member[at], query[at]))
                at, mt, qt, member, query = (np.concatenate(c) for c in zip(*parts))
                turned = x @ turn
                for i in range(0, len(at), 20_000):
                    j = at[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(groups[j], pa.int32()), pa.array(mt[i : i + 20_000], pa.int32()),
                         pa.array(qt[i : i + 20_000], pa.int32()), b.column(0).take(pa.array(rows[j])),
                         pa.array(member[i : i + 20_000]), pa.array(query[i : i + 20_000]), binary(turned[rows[j]])],
                        ["grp", "mt", "qt", "cls", "home", "asks", "vec"],
                    )

        return self.entries.select("cls", "vec").mapInArrow(
            run, "grp int, mt int, qt int, cls long, home boolean, asks boolean, vec binary"
        )

    def neighbours(self, k: int) -> DataFrame:
        """(cls, others): arrays of (c: minus cosine, o: cls), best first."""
        if self.lists is None:
            return self.entries.select("cls", F.expr("cast(array() as array<struct<c:double,o:long>>)").alias("others"))
        tiled = self.tiles(k)
        dim, index = self.dim, self.lists.turned(self.turn)

        def tile(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            cls = rows.column("cls").to_numpy()
            order = np.argsort(cls, kind="stable")  # ties go to the smaller hash
            cls, home, asks = cls[order], *(rows.column(c).to_numpy()[order] for c in ("home", "asks"))
            x = matrix(rows.column("vec").chunk(0), dim)[order]
            lists = np.flatnonzero(index.group == rows.column("grp")[0].as_py())
            at, probes = index.probed(x, lists)
            asked, best, score, *_ = scan_lists(x, np.searchsorted(lists, at), home, asks, probes, k)
            return pa.Table.from_batches([_listed(cls[asked], cls[best], score)])

        # a query has k entries at most per tile of the groups it probes
        return _best(tiled.groupBy("grp", "mt", "qt").applyInArrow(tile, "cls long, o array<long>, c array<double>"), k)


class Reach:
    """Which lists can hold a vector within a cosine of ``least`` of another.

    A list has two units: its core, and its rim of the members that are more than
    three times the angle of ``least`` away from the centre.  A vector meets the
    units that the border between two lists and the angles to the centre allow:
    both bounds are exact.  As they hold for either vector of a pair, only the one
    in the unit of the higher number asks; units of rims have the higher ones.
    """

    def __init__(self, lists: Lists, least: float):
        self.centres, self.apart, self.least = lists.centres, lists.apart, least
        self.angle = float(np.arccos(least)) + 1e-3
        self.border, self.cut = (1 - least * least) ** 0.5, 3 * self.angle
        #: Group of each unit; all rims are one.
        self.group = np.concatenate([lists.group, np.full(len(lists.centres), lists.groups)])

    def met(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit of each row; row and group of every group that it belongs to or asks)."""
        n, groups = len(self.centres), int(self.group[-1]) + 1
        units, pairs = np.empty(len(x), np.int64), []
        for i in range(0, len(x), 4096):
            c = x[i : i + 4096] @ self.centres.T
            own, top = c.argmax(1), c.max(1)
            home = np.where(np.arccos(np.minimum(top, 1)) > self.cut, own + n, own)
            r, at = np.nonzero(top[:, None] - c <= self.border * self.apart[own] + 1e-5)
            angle = np.arccos(np.clip(c[r, at], -1, 1))
            core = (at < home[r]) & (angle <= self.cut + self.angle)
            rim = (at + n < home[r]) & (angle >= self.cut - self.angle)
            rows = np.concatenate([np.arange(len(own)), r[core], r[rim]]) + i
            asked = np.concatenate([home, at[core], at[rim] + n])
            units[i : i + 4096] = home
            pairs.append(np.unique(rows * groups + self.group[asked]))
        pairs = np.concatenate(pairs) if pairs else units
        return units, pairs // groups, pairs % groups

    def asks(self, home: np.ndarray, later: np.ndarray, x: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether rows ask each of ``units``, angles to their centres).  ``home``:
        the units of the rows; ``later``: rows that ask units of any number."""
        n = len(self.centres)
        c = x @ self.centres[units % n].T
        top = np.einsum("ij,ij->i", x, self.centres[home % n])
        angle = np.arccos(np.clip(c, -1, 1))
        within = np.where(units < n, angle <= self.cut + self.angle, angle >= self.cut - self.angle)
        near = top[:, None] - c <= self.border * self.apart[(home % n)[:, None], units % n] + 2e-5
        return (later[:, None] | (home[:, None] > units)) & within & near, angle


class Part:
    """Members of a part of a group, compared with each other and then with rows
    that ask them.  ``best`` (names, where ``score`` is above -2) and ``score``
    (cosines) are the members' k best; ``tested`` counts the pairs compared."""

    def __init__(self, reach: Reach, x: np.ndarray, home: np.ndarray, names: np.ndarray, k: int):
        self.reach, self.names, self.k, self.tested = reach, names, k, 0
        self.best, self.score = self._none(len(x))
        first, dim = round(ENDS[0] * x.shape[1]), x.shape[1]
        self.first = first
        self.limit = first / dim * (2 - 2 * reach.least) * (1 + EPS_SURE / first**0.5) ** 2 + 1e-5
        self.numbers, self.units = np.unique(home), []
        for u in self.numbers:
            rows = np.flatnonzero(home == u)
            angle = np.arccos(np.clip(x[rows] @ reach.centres[u % len(reach.centres)], -1, 1))
            order = np.argsort(angle, kind="stable")
            rows, angle = rows[order], angle[order]
            v, norm = x[rows], np.einsum("ij,ij->i", x[rows, :first], x[rows, :first])[:, None]
            right = np.ascontiguousarray(np.concatenate([v[:, :first], np.ones_like(norm), -norm / 2], 1).T)
            self.units.append((rows, angle, v, right))
            self._meet(self.units[-1], v, angle, rows, names, self.best, self.score, True)
        self._ask(x, home, names, np.zeros(len(x), bool), self.best, self.score)

    def _none(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((n, self.k), np.int64), np.full((n, self.k), -2.0, np.float32)

    def ask(self, x: np.ndarray, home: np.ndarray, names: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best, score) of rows that are no members."""
        best, score = self._none(len(x))
        self._ask(x, home, names, later, best, score)
        return best, score

    def _ask(self, x, home, names, later, best, score) -> None:
        for a in range(0, len(x), 16_384):
            asks, angles = self.reach.asks(home[a : a + 16_384], later[a : a + 16_384], x[a : a + 16_384], self.numbers)
            for i in np.flatnonzero(asks.any(0)):
                rows = np.flatnonzero(asks[:, i])
                rows = rows[np.argsort(angles[rows, i], kind="stable")]
                self._meet(self.units[i], x[rows + a], angles[rows, i], rows + a, names, best, score)

    def _meet(self, unit, x, angle, at, names, best, score, same=False) -> None:
        """Compare rows (``at`` in names, best and score) with a unit, or with
        those of it that come after them if they are the ``same``; both by angle."""
        members, angles, y, right = unit
        first = self.first
        norm = np.einsum("ij,ij->i", x[:, :first], x[:, :first])[:, None]
        # the test is part of the product: above zero is within the limit
        left = np.concatenate([x[:, :first], (self.limit - norm) / 2, np.ones_like(norm)], 1).astype(np.float32)
        for a in range(0, len(x), _QUERIES):
            b = min(a + _QUERIES, len(x))
            lo = a if same else np.searchsorted(angles, angle[a] - self.reach.angle)
            hi = np.searchsorted(angles, angle[b - 1] + self.reach.angle, "right")
            for m0 in range(lo, hi, 2 * _MEMBERS):
                m1 = min(m0 + 2 * _MEMBERS, hi)
                self.tested += (b - a) * (m1 - m0)
                close = np.flatnonzero((left[a:b] @ right[:, m0:m1]).reshape(-1) > 0)
                if not len(close):
                    continue
                i, j = a + close // (m1 - m0), m0 + close % (m1 - m0)
                if len(close) * 16 > (b - a) * (m1 - m0):  # a crowd
                    v = (x[a:b] @ y[m0:m1].T).reshape(-1)[close]
                else:
                    v = np.einsum("ij,ij->i", x[i], y[j])
                ok = v >= self.reach.least - 1e-6
                if same:
                    ok &= j > i
                q, m, v = at[i[ok]], members[j[ok]], v[ok]
                self._put(best, score, q, self.names[m], v)
                self._put(self.best, self.score, m, names[q], v)

    @staticmethod
    def _put(best, score, rows, names, values) -> None:
        ok = np.flatnonzero(values >= score[rows, -1])
        if len(ok):
            ok = ok[np.argsort(rows[ok], kind="stable")]
            _merge(best, score, rows[ok], names[ok], values[ok])


class Close(Index):
    """Index of the pairs with a cosine of ``least`` (above 0) and more: each is
    tested once, for both of its vectors, and nothing is compared for the sake of
    less similar neighbours.  Groups are cut into parts; a task holds the members
    of one, and the rows that ask it pass by: those of later parts of the group,
    and those of other groups."""

    MOST = 256

    def __init__(self, entries: DataFrame, dim: int, n: int, least: float):
        super().__init__(entries, dim, n)
        self.least = least
        if self.lists is not None and n > PART * self.lists.groups:
            centres = self.lists.centres
            middles = spherical_kmeans(centres, -(-n // PART))
            self.lists = Lists(centres, np.unique((centres @ middles.T).argmax(1), return_inverse=True)[1])

    def rows(self) -> DataFrame:
        """(grp, part, asks, later, home, cls, vec): every entry as a member of its
        part, and as one that asks others; ``vec`` is rotated."""
        reach, turn, dim = Reach(self.lists, self.least), self.turn, self.dim
        groups = self.lists.groups + 1

        def numbers(x: np.ndarray) -> np.ndarray:
            home, rows, grp = reach.met(x)
            return grp[reach.group[home[rows]] == grp]

        cuts = np.maximum(1, -(-self._counts(groups, numbers) // PART))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column(1), dim)
                if not len(x):
                    continue
                home, rows, grp = reach.met(x)
                key = mix(np.asarray(b.column(0)).view(np.uint64))[rows]
                parts = cuts[grp]
                member = reach.group[home[rows]] == grp
                own = np.where(member, (key % parts.astype(np.uint64)).astype(np.int64), parts)
                sent = [(at, np.full(len(at), i)) for i in range(int(parts.max()))
                        for at in [np.flatnonzero((i <= own) & (i < parts))]]
                at, part = (np.concatenate(c) for c in zip(*sent))
                turned = x @ turn
                for i in range(0, len(at), 20_000):
                    j, p = at[i : i + 20_000], part[i : i + 20_000]
                    r = rows[j]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grp[j], pa.int32()), pa.array(p, pa.int32()), pa.array(own[j] != p),
                         pa.array(member[j]), pa.array(home[r], pa.int32()), b.column(0).take(pa.array(r)), binary(turned[r])],
                        ["grp", "part", "asks", "later", "home", "cls", "vec"],
                    )

        return self.entries.select("cls", "vec").mapInArrow(
            run, "grp int, part int, asks boolean, later boolean, home int, cls long, vec binary"
        )

    def neighbours(self, k: int) -> DataFrame:
        """(cls, others) as of ``Index``, of cosines of about ``least`` and more;
        vectors without any may be missing."""
        if self.lists is None:
            return super().neighbours(k)
        dim, reach = self.dim, Reach(self.lists.turned(self.turn), self.least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, part = None, [], None
            for b in batches:
                grp, cut, asks, later, home, cls = (b.column(c).to_numpy(zero_copy_only=False) for c in range(6))
                x = matrix(b.column(6), dim)
                turns = np.flatnonzero((np.diff(grp) != 0) | (np.diff(cut) != 0) | (asks[1:] != asks[:-1])) + 1
                for a, z in zip([0, *turns], [*turns, len(x)]):
                    if a == z:
                        continue
                    if key != (grp[a], cut[a]):
                        yield from finish(held, part)
                        key, held, part = (grp[a], cut[a]), [], None
                    mine = x[a:z], home[a:z].astype(np.int64), cls[a:z]
                    if not asks[a]:  # members come first
                        held.append(tuple(c.copy() for c in mine))
                        continue
                    if part is None and held:
                        part, held = start(held), []
                    if part is not None:
                        yield _listed(cls[a:z], *part.ask(*mine, later[a:z]))
            yield from finish(held, part)

        def start(held: list) -> Part:
            return Part(reach, *(np.concatenate(c) for c in zip(*held)), k)

        def finish(held: list, part: Part | None) -> Iterator[pa.RecordBatch]:
            part = start(held) if held else part
            if part is not None:
                yield _listed(part.names, part.best, part.score)

        rows = self.rows().repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")
        return _best(rows.mapInArrow(run, "cls long, o array<long>, c array<double>"), k)


def _prepared(points: DataFrame, id_col: str, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame, int]:
    units = write(unit_vectors(points, vector_col, [id_col], dim).withColumnRenamed(id_col, "id"), "units")
    rows = units.df
    members = write(rows.select("id", "cls").distinct(), "unit-members").df
    entries = write(rows.groupBy("cls").agg(F.first("vec").alias("vec")), "unit-entries").df
    units.drop()
    return members, entries, entries.count()


def neighbours(points: DataFrame, id_col: str = "point_id", vector_col: str = "embedding", k: int = 5,
               dim: int = 64) -> DataFrame:
    """(id, rank_no, other_id, cosine): the k most similar other points."""
    return _expanded(points, id_col, vector_col, k, dim, -1.0)


def _expanded(points: DataFrame, id_col: str, vector_col: str, k: int, dim: int, least: float) -> DataFrame:
    members, entries, n = _prepared(points, id_col, vector_col, dim)
    found = (Close(entries, dim, n, least) if least > 0 else Index(entries, dim, n)).neighbours(k)
    pairs = write(
        found.select("cls", F.posexplode("others").alias("at", "x"))
        .select("cls", "at", F.col("x.o").alias("other"), (-F.col("x.c")).alias("cosine"))
        .where(F.col("cosine") >= least),
        "neighbours",
    ).df
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    several = write(sizes.where("n > 1"), "unit-copies").df
    # the first k + 1 ids of a class are all that any neighbour list can use;
    # the limit is applied before the shuffle
    w = Window.partitionBy("cls").orderBy("id")
    firsts = write(
        members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1), "unit-firsts"
    ).df
    # copies of a point come first: the smallest k ids other than its own
    ranked = several.join(firsts, "cls").select("cls", F.col("id").alias("other_id"), "r")
    everyone = members.join(several, "cls").select("cls", "id")
    copies = everyone.join(ranked, "cls").where("id <> other_id").withColumn(
        "rank_no", F.row_number().over(Window.partitionBy("id").orderBy("r"))
    ).where(F.col("rank_no") <= k).select("id", "rank_no", "other_id", F.lit(1.0).alias("cosine"))
    # then other classes, each with its first ids, while there is room
    n_own = F.coalesce("n_own", F.lit(1))
    n_other = F.coalesce("n_other", F.lit(1))
    rooms = (
        pairs.join(several.select("cls", F.col("n").alias("n_own")), "cls", "left")
        .join(several.select(F.col("cls").alias("other"), F.col("n").alias("n_other")), "other", "left")
        .select("cls", "at", "other", "cosine", n_own.alias("n_own"), n_other.alias("n_other"))
        .where(F.col("n_own") <= k)
        .withColumn(
            "before",
            F.coalesce(F.sum("n_other").over(
                Window.partitionBy("cls").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            + F.col("n_own") - 1,
        )
        .where(F.col("before") < k)
    )
    others = (
        rooms.join(firsts.select(F.col("cls").alias("other"), F.col("id").alias("other_id"), "r"), "other")
        .withColumn("rank_no", (F.col("before") + F.col("r")).cast("int"))
        .where(F.col("rank_no") <= k)
        .join(firsts.select("cls", "id"), "cls")
        .select("id", "rank_no", "other_id", "cosine")
    )
    return copies.unionByName(others)


def found_pairs(points: DataFrame, least: float = 0.95) -> DataFrame:
    """(point_id_a, point_id_b) of close points of which one is among the
    other's five most similar."""
    got = _expanded(points, "point_id", "embedding", 5, 64, least)
    return got.select(
        F.least("id", "other_id").alias("point_id_a"), F.greatest("id", "other_id").alias("point_id_b")
    ).distinct()
