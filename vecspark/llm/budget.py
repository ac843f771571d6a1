"""Token budget per source, language and domain.

Texts are cut into pieces by the tokenizer's own pattern (in the JVM); distinct
pieces, sorted and split by range, are the leaves of prefix tries, one trie per
partition.  A walk along the sorted pieces keeps the tokenization state of the
current prefix (last token and number of tokens at every byte) on a stack, so a
shared prefix is tokenized once.  The state is exact: of all tokens that end at
a byte just one forms a valid pair with the last token before it, and for BPE a
sequence is valid if all its adjacent pairs are.  Terminal counts are then
joined to the documents' pieces.

Defined cases: null and empty texts have no tokens but count as documents;
missing, broken or blank metadata falls back to the source's entry and then to
null; repeated rows count each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.tokens import Bpe, bpe, default_vocabulary
from vecspark.runtime import python_space, write

#: Distinct pieces, the most frequent ones of up to 64 letters, that are broadcast.
OFTEN = 500_000

_WS = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The tokenizer's pattern with white space spelt out for Java.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WS + r"\p{L}\p{N}]+|["
    + _WS + r"]+(?![^" + _WS + r"])|[" + _WS + "]+"
)

#: Fixed spellings of languages met in metadata, by their code.
LANGUAGES = {
    "en": ["english", "eng", "englisch", "anglais", "inglés", "ingles"],
    "de": ["german", "deutsch", "ger", "deu", "allemand", "alemán", "aleman"],
    "fr": ["french", "français", "francais", "fra", "fre", "französisch", "francés"],
    "es": ["spanish", "español", "espanol", "spa", "spanisch", "espagnol", "castellano"],
}


class Walk:
    """Tokenization states along the pieces of one sorted partition."""

    def __init__(self, v: Bpe):
        self.v = v
        self.ids = v.ranks
        self.longest = v.longest
        self.valid: dict[tuple[int, int], bool] = {}
        self.data = b""
        self.last: list[int] = []  # last token of the encoding of every prefix
        self.count: list[int] = []  # its number of tokens

    def _pair(self, a: int, b: int) -> bool:
        got = self.valid.get((a, b))
        if got is None:
            if len(self.valid) > 2_000_000:
                self.valid.clear()
            got = self.valid[a, b] = self.v.piece(self.v.bytes_of[a] + self.v.bytes_of[b]) == [a, b]
        return got

    def tokens(self, data: bytes) -> int:
        """Number of tokens of a piece, reusing the states of the prefix that
        it shares with the piece before."""
        n = min(len(data), len(self.data))
        same = 0
        while same < n and data[same] == self.data[same]:
            same += 1
        del self.last[same:], self.count[same:]
        ids, last, count = self.ids, self.last, self.count
        for end in range(same + 1, len(data) + 1):
            for begin in range(max(0, end - self.longest), end):
                t = ids.get(data[begin:end])
                if t is None:
                    continue
                if begin == 0:
                    last.append(t)
                    count.append(1)
                    break
                if self._pair(last[begin - 1], t):
                    last.append(t)
                    count.append(count[begin - 1] + 1)
                    break
        self.data = data
        return count[-1] if count else 0


def piece_tokens(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n) of a one-column table of distinct pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(bpe(vocabulary))
        for b in batches:
            out = [walk.tokens(p.encode()) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], ["piece", "n"])

    return pieces.repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(run, "piece string, n int")


def document_tokens(df: DataFrame, keep: list[str], text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``tokens`` for every row that has at least one token;
    ``keep`` has to name the row."""
    path = vocabulary or default_vocabulary()
    cut = df.select(
        *keep, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PIECES), F.lit(0))).alias("piece")
    )
    seen = write(cut.groupBy("piece").agg(F.count(F.lit(1)).alias("uses")), "pieces").df
    counts = write(piece_tokens(seen.select("piece"), path).join(seen, "piece"), "piece-tokens").df
    # the pieces that make up most of a text are few: a bounded number of short
    # ones is broadcast, and rows of all others meet in a shuffle join
    often = counts.where(F.length("piece") <= 64).orderBy(F.desc("uses"), "piece").limit(OFTEN).select("piece", "n")
    often = F.broadcast(write(often.withColumn("often", F.lit(True)), "piece-often").df)
    met = cut.join(often, "piece", "left")
    here = met.groupBy(*keep).agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("often").isNull(), F.col("piece"))).alias("rest")
    )
    here = write(here, "piece-sums").df
    rest = here.where(F.size("rest") > 0).select(*keep, F.explode("rest").alias("piece")).join(counts.select("piece", "n"), "piece")
    return (
        here.select(*keep, "n").unionByName(rest.select(*keep, "n"))
        .groupBy(*keep).agg(F.sum("n").cast("long").alias("tokens"))
    )


def _clean(c: Column) -> Column:
    ws = python_space()
    return F.nullif(F.lower(F.regexp_replace(c, f"^[{ws}]+|[{ws}]+$", "")), F.lit(""))


def language(df: DataFrame, column: str, spelt: Column) -> DataFrame:
    """``df`` with the language code of many spellings; null where there is none."""
    head = F.split(_clean(spelt), "[-_]")[0]
    codes = F.create_map(*(F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)))
    df = df.withColumn("_head", head)
    known = F.coalesce(F.try_element_at(codes, F.coalesce("_head", F.lit(""))), F.col("_head"))
    return df.withColumn(column, F.when(~F.col("_head").isin("und", "unknown", "null", "none"), known)).drop("_head")


def token_budget(store: DataFrame, sources: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(source_id, language, domain, documents, tokens)."""
    own = store.select(
        F.col("document_id").alias("id"), F.col("source_id"), F.json_tuple("metadata", "lang", "domain").alias("_lang", "_domain")
    ).withColumn("own_domain", _clean(F.col("_domain")))
    own = language(own, "own_lang", F.col("_lang"))
    listed = language(sources, "_lang", F.col("default_lang")).groupBy(F.col("source_id").alias("listed_id")).agg(
        F.min("_lang").alias("listed_lang"), F.min(_clean(F.col("source_domain"))).alias("listed_domain"),
    )
    placed = own.join(listed, F.col("source_id") == F.col("listed_id"), "left").select(
        "id", "source_id",
        F.coalesce("own_lang", "listed_lang").alias("language"),
        F.coalesce("own_domain", "listed_domain").alias("domain"),
    )
    counted = document_tokens(
        store.select(F.col("document_id").alias("id"), "content"), ["id"], "content", vocabulary
    )
    return (
        placed.join(counted, "id", "left")
        .groupBy("source_id", "language", "domain")
        .agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    )
