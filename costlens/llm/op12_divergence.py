"""12. Source divergence audit: how the terms of a language's sources differ, priced over hash-consed segment trees.

Texts become counts of (language, source, term) in their tasks, so a source with a third of all rows
is a few rows a term by then. Kept terms of a language are dealt to blocks of about ``BLOCK`` by a hash
and numbered in each, the most frequent first. In a block, every group's counts are the leaves of a segment
tree whose nodes are hash-consed: equal subtrees are one node, of whichever group. Two trees are walked at the
same time from their roots; a pair of nodes met in several places is priced once, times the
number of places. Blocks and tiles of sources are tasks of their own, whose sums make a pair's value.

Probabilities are whole billionths, by integer division throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, table, text_of

MIN_DOCS, TOP_TERMS, PRIOR, SCALE = 30, 50, 5, 10**9
#: Kept terms of a block and sources of a tile (on average, as both are dealt by a hash): a task holds the counts of two tiles over one block.
BLOCK, TILE = 4096, 64
#: Entries that a map task gathers before it hands them on; bytes of a text that are cut into words at once; pairs of nodes that are expanded at once.
HELD_TERMS, CUT_BYTES, PAIRS_AT_ONCE = 300_000, 1 << 20, 1 << 20

#: Bytes of terms as they are, A-Z lower-cased, all others as spaces.
_TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    plain, at = text.translate(_TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + CUT_BYTES)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, term, n, docs)``: occurrences and documents of each term in each group; a row without a term for each group.

    Nulls count as empty. A task hands on what it has counted whenever it holds ``HELD_TERMS`` terms.
    """

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in held.items():
            terms = [None, *n]
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(seen.__getitem__, n)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in _terms((text.as_py() or "").encode("utf-8")):
                    n.update(terms)
                    own.update(terms)
                seen.update(own)
            if sum(len(n) + 1 for n, _ in held.values()) > HELD_TERMS:
                yield from rows(held)
                held = {}
        yield from rows(held)

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    given = text_of(docs.select(*named, "text"), "lang", "source")
    found = given.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _with(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    """A join with a table of a row a key: broadcast while a count shows it to be small, else left to a shuffle, which Spark splits where it is skewed."""
    return rows.join(F.broadcast(few) if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few, list(keys))


def billionths(n: str | Column, total: str | Column, kept: str | Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept))`` as a long division by three digits at a time: exact for totals up to 9 * 10^15."""
    n, total, kept = (F.col(c) if isinstance(c, str) else c for c in (n, total, kept))
    divide = lambda a, b: F.call_function("div", a, b)
    below, rest = total + PRIOR * kept, n + PRIOR
    found = divide(rest, below)
    for _ in range(3):
        rest = (rest % below) * 1000
        found = found * 1000 + divide(rest, below)
    return found + 1


def _billionths(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same over numpy columns."""
    below, rest = total + PRIOR * kept, n + PRIOR
    found = rest // below
    for _ in range(3):
        rest = (rest % below) * 1000
        found = found * 1000 + rest // below
    return found + 1


class Trees:
    """Segment trees over a block's term numbers, one a group, with shared nodes: ``roots[g]`` is group g's root.

    ``levels[k]`` holds the two children of each node of the level over it, ``leaves`` the counts; -1 stands beyond the last term.
    """

    def __init__(self, counts: np.ndarray):
        groups, width = counts.shape
        size = 1 << max(0, width - 1).bit_length()
        padded = np.full((groups, size), -1, np.int64)
        padded[:, :width] = counts
        self.leaves, nodes = np.unique(padded, return_inverse=True)
        nodes = nodes.reshape(groups, size)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        known = len(self.leaves)
        while nodes.shape[1] > 1:
            both, own = np.unique(nodes[:, ::2] * known + nodes[:, 1::2], return_inverse=True)
            self.levels.append((both // known, both % known))
            nodes, known = own.reshape(groups, -1), len(both)
        self.roots = nodes[:, 0]

    def prices(self, left: np.ndarray, right: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
        """Sum of differences of probabilities for each pair of groups ``left[i]``, ``right[i]``."""
        pair, a, b = np.arange(len(left)), self.roots[left], self.roots[right]
        times = np.ones(len(left), np.int64)
        same_total = totals[left] == totals[right]
        for first, second in reversed(self.levels):
            pair, a, b, times = self._once(np.tile(pair, 2), np.concatenate([first[a], second[a]]), np.concatenate([first[b], second[b]]), np.tile(times, 2), same_total)
        n_a, n_b = self.leaves[a], self.leaves[b]
        there = n_a >= 0
        pair, n_a, n_b, times = pair[there], n_a[there], n_b[there], times[there]
        price = np.abs(_billionths(n_a, totals[left[pair]], kept) - _billionths(n_b, totals[right[pair]], kept)) * times
        out = np.zeros(len(left), np.int64)
        np.add.at(out, pair, price)
        return out

    @staticmethod
    def _once(pair, a, b, times, same_total):
        """Each pair of nodes once for each pair of groups, with the number of places; equal nodes under equal totals cost nothing and go."""
        some = ~((a == b) & same_total[pair])
        pair, a, b, times = pair[some], a[some], b[some], times[some]
        wide_a, wide_b = int(a.max(initial=0)) + 1, int(b.max(initial=0)) + 1
        keys, own = np.unique((pair * wide_a + a) * wide_b + b, return_inverse=True)
        summed = np.zeros(len(keys), np.int64)
        np.add.at(summed, own, times)
        rest, b = np.divmod(keys, wide_b)
        pair, a = np.divmod(rest, wide_a)
        return pair, a, b, summed


def _price_tile(task: pa.Table) -> pa.Table:
    """Differences of all pairs of sources of two tiles (or of one) over a block."""
    lang, low, high = (task.column(c)[0].as_py() for c in ("lang", "low", "high"))
    pos = task.column("pos").to_numpy()
    told = task.filter(pa.array(pos < 0)).sort_by("source")
    counted = task.filter(pa.array(pos >= 0))
    sources, tiles = told.column("source").to_pylist(), told.column("tile").to_pylist()
    kept, width = told.column("kept")[0].as_py(), told.column("n_terms")[0].as_py()
    totals = told.column("n").to_numpy()
    place = {s: i for i, s in enumerate(sources)}
    pairs = combinations(range(len(sources)), 2) if low == high else product((i for i, t in enumerate(tiles) if t == low), (i for i, t in enumerate(tiles) if t == high))
    pairs = np.array(list(pairs), np.int64).reshape(-1, 2)
    values = np.zeros(len(pairs), np.int64)
    if width:
        counts = np.zeros((len(sources), width), np.int64)
        counts[[place[s] for s in counted.column("source").to_pylist()], counted.column("pos").to_numpy()] = counted.column("n").to_numpy()
        trees, step = Trees(counts), max(1, PAIRS_AT_ONCE // width)
        for at in range(0, len(pairs), step):
            values[at : at + step] = trees.prices(pairs[at : at + step, 0], pairs[at : at + step, 1], totals, kept)
    names = np.array(sources, object)
    return pa.table({"lang": pa.array([lang] * len(pairs), pa.string()), "a": pa.array(names[pairs[:, 0]], pa.string()), "b": pa.array(names[pairs[:, 1]], pa.string()), "value": pa.array(values, pa.int64())})


class Audit:
    """Counts of ``docs(text, lang, source)`` and what hangs on them: written once, read by both parts."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, tile: int = TILE):
        counts = cut(term_counts(docs), "term-counts")
        kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= min_docs)
        kept = cut(kept.drop("docs"), "kept-terms")
        every = counts.filter("term is null").select("lang", "source")
        terms = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_n"))
        langs = every.groupBy("lang").agg(F.count("*").alias("sources")).join(terms, "lang", "left").fillna(0, ["kept", "lang_n"])
        at_least = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
        #: lang, sources, kept (terms), lang_n (their occurrences), blocks, tiles
        self.langs = cut(langs.withColumns({"blocks": at_least(F.col("kept"), block), "tiles": at_least(F.col("sources"), tile)}), "langs")
        dealt = _with(kept, self.langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        order = Window.partitionBy("lang", "block").orderBy(F.col("all_n").desc(), "term")
        numbered = cut(dealt.select("lang", "term", "all_n", "block", (F.row_number().over(order) - 1).alias("pos")), "numbered-terms")
        #: lang, source, term, n, all_n, block, pos: the kept terms of each group
        self.facts = cut(counts.filter("term is not null").drop("docs").join(numbered, ["lang", "term"]), "facts")
        totals = self.facts.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        #: lang, source, group_n: every group, also those without terms
        self.groups = cut(every.join(totals, ["lang", "source"], "left").fillna(0, ["group_n"]), "groups")
        self.blocks = numbered.groupBy("lang", "block").agg(F.count("*").cast("int").alias("n_terms"))

    def pairs(self) -> DataFrame:
        """``(lang, source, item, value)``: how far each other source of the language is from a source, over all kept terms."""
        langs = self.langs.filter("sources > 1").select("lang", "kept", "blocks", "tiles")
        tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        spread = lambda rows: rows.withColumn("tile", tile).withColumn("other", others).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        groups = spread(_with(self.groups, langs, "lang")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(self.blocks, ["lang", "block"], "left")
        told = groups.select("lang", "block", "low", "high", "tile", "source", F.lit(-1).alias("pos"), F.col("group_n").alias("n"), "kept", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
        counted = spread(_with(self.facts, langs, "lang")).select("lang", "block", "low", "high", "tile", "source", "pos", "n", F.lit(0).cast("bigint").alias("kept"), F.lit(0).alias("n_terms"))
        priced = told.unionByName(counted).groupBy("lang", "block", "low", "high").applyInArrow(_price_tile, "lang string, a string, b string, value bigint")
        summed = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        return summed.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")

    def terms(self) -> DataFrame:
        """``(lang, source, item, value)``: the kept terms that a group has more often than its language, and by how much."""
        rows = _with(_with(self.facts, self.groups, "lang", "source"), self.langs.select("lang", "kept", "lang_n"), "lang")
        value = billionths("n", "group_n", "kept") - billionths("all_n", "lang_n", "kept")
        return rows.filter("n > 0").select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``docs(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``: for each group the distance to every other source (``pair``) and its ``top_terms`` foremost terms (``term``).

    Ranks go by value, greatest first, equal ones by item. Null text, lang and source count as empty; repeated rows count as often as they are there; other columns
    aren't read; an empty table gives no rows. A language without kept terms has pairs of value 0, a single source none.
    """
    audit = Audit(docs, min_docs, block, tile)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    part = lambda rows, name: rows.withColumns({"part": F.lit(name), "rank": rank})
    out = part(audit.pairs(), "pair").unionByName(part(audit.terms(), "term").filter(F.col("rank") <= top_terms))
    return out.select("lang", "source", "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: divergence of all sources of each language."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS doc_id, text, lang, source FROM documents)),
groups AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
kept AS (SELECT lang, term, count(*) AS all_n FROM words GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(all_n) AS lang_n FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, k.all_n, coalesce(c.n, 0) AS n, l.v, l.lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS group_n
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
priced AS (
  SELECT lang, source, term, n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (CAST(group_n AS HUGEINT) + 5 * v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (all_n + 5) // (CAST(lang_n AS HUGEINT) + 5 * v) AS BIGINT) AS q
  FROM dense),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
