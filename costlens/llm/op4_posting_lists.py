"""4. Approximate nearest neighbours by balanced posting lists around centroids.

Equal vectors are one entry with their smallest ids, so a vector that fills a third of the table is one
entry too. Centroids are fitted on a bounded sample so that no list of the sample is far over its share; every entry goes to the list of its
nearest centroid and, near a border, to those of all others at nearly that distance. The lists are then counted over the whole table, and each
that is overfull is split by centroids of its own, fitted on a sample of its entries and kept in a table: lists stay short as the table
grows. A query opens its nearest lists, by number or by ratio of distances, and within a split list the parts within a ratio of the nearest one's
distance, and more if it finds too few there; both limits are measured: some of the queries are compared with the whole table, and the limits are those that reach a target of the true
neighbours through the lists as they are. A query is compared with all entries of the lists that it opens. Its nearest list comes
first, then three times as many, then twelve, and so on; each time only entries at least as near as the last one found before come back. Queries and entries meet by list; a
list with many of either is dealt into blocks. Inner products become distances by one more coordinate that evens out the norms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import copied, cut, dealt, hot_keys, table

#: Vectors that the centroids are fitted on (least hash first), entries that a list should have, and most lists of the first level.
SAMPLE, LIST_SIZE, MAX_LISTS = 20_000, 200, 4096
#: A list of over SPLIT times its share of entries is split, by centroids fitted on about PART_SAMPLE of its entries.
SPLIT, PART_SAMPLE = 3, 8192
#: An entry goes to lists within this ratio of its nearest distance; parts are opened within OPEN if no ratio was measured.
CLOSURE, OPEN = 1.02, 1.1
#: How many queries are compared with the whole table, and the shares of their neighbours to reach within the opened lists' parts, and in all.
PROBED, PART_TARGET, TARGET = 256, 0.985, 0.97
#: Lists that every query opens at least, so that small tables are searched whole.
LEAST_LISTS = 8
#: Lists are compared in turns, the nearest first; each turn has so many times the lists of all before it.
GROWTH = 4
#: Entries, and queries, of one block of a list.
ENTRIES, QUERIES = 16_384, 2048
#: Lists from here on are parts of split ones.
PART = 1 << 32
NEAREST = 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more coordinate, so that all are as far from the point ``(0, ..., 0, sqrt(largest))`` and nearness is the inner product.

    The coordinate is small for a row of small norm, so one huge vector does not blur the distances of all others.
    """
    square = (x * x).sum(1)
    return np.concatenate([x, (square / (np.sqrt(largest) + np.sqrt(np.maximum(0, largest - square))))[:, None]], 1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    middle = np.median(c, 0)
    x, c = x - middle, c - middle
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T))


def fit_centroids(x: np.ndarray, n: int, rounds: int = 12, most: float = 2.0) -> np.ndarray:
    """Balanced k-means: an empty cluster, and the smallest ones as long as some cluster holds over ``most`` times its share, restart in the largest clusters."""
    rng = np.random.Generator(np.random.PCG64(11))
    c = x[rng.permutation(len(x))[:n]].copy()
    for t in range(rounds):
        near = np.concatenate([_distances(x[lo : lo + 4096], c).argmin(1) for lo in range(0, len(x), 4096)])
        many = np.bincount(near, minlength=len(c))
        for k in range(x.shape[1]):
            c[:, k] = np.bincount(near, weights=x[:, k], minlength=len(c)) / np.maximum(1, many)
        full = np.argsort(-many, kind="stable")
        full = full[many[full] > most * len(x) / len(c)][: len(c) // 4]
        small = np.argsort(many, kind="stable")[: max(len(full), int((many == 0).sum()))]
        if t + 2 < rounds or (many == 0).any():  # the last rounds settle
            for i, k in enumerate(small if t + 2 < rounds else small[many[small] == 0]):
                own = np.flatnonzero(near == (full[i % len(full)] if len(full) else many.argmax()))
                c[k] = x[own[rng.integers(len(own))]]
    return c


def _farness(q: np.ndarray, c: np.ndarray, largest: float) -> np.ndarray:
    """Grows with the distance of queries, brought to the largest norm, to lifted centroids; for a lifted entry it is minus the inner product with the unit query."""
    unit = q / np.maximum(1e-300, np.sqrt((q * q).sum(1)))[:, None]
    return (c * c).sum(1)[None] / (2 * np.sqrt(largest)) - c[:, -1][None] - unit @ c[:, :-1].T


def _ratios(far: np.ndarray, largest: float) -> np.ndarray:
    """Distances of queries as multiples of the nearest one's."""
    d = np.sqrt(np.maximum(0, 2 * largest + 2 * np.sqrt(largest) * far))
    return d / np.maximum(d.min(1, keepdims=True), 1e-12 * np.sqrt(largest))


def _places(far: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(far, 1, kind="stable"), 1, kind="stable")


def _within(d: np.ndarray, ratio: float) -> np.ndarray:
    return d <= ratio * (1 + 1e-9) * d.min(1, keepdims=True)


def _post(shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, largest = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                rows, lists = np.nonzero(_within(_distances(_lifted(_matrix(part.column(1), width), largest), c), CLOSURE))
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))], names=["list", "rep", "vec"])

    return run


def _probe(shared, width: int, places: float, ratio: float):
    """(query, vec) -> a row for each list that the query opens, its ``places`` nearest within ``ratio`` and LEAST_LISTS at least; ``first`` marks the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, largest = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                far = _farness(_matrix(part.column(1), width), c, largest)
                place = _places(far)
                rows, lists = np.nonzero((place < LEAST_LISTS) | (place < places) & (_ratios(far, largest) <= ratio))
                place = place[rows, lists]
                turn = np.where(place < 1, 0, 1 + np.floor(np.log(np.maximum(1, place)) / np.log(GROWTH) + 1e-9)).astype(np.int32)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int64)), pa.array(place == 0), pa.array(turn), part.column(0).take(at), part.column(1).take(at)], names=["list", "first", "turn", "query", "vec"])

    return run


def _by_force(shared, width: int, keep: int):
    """(rep, vec) -> for each of some queries the ``keep`` best entries of the task that reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, floor = shared.value
        best, reps = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                best = np.concatenate([best, q @ _matrix(part.column(1), width).T], 1)
                reps = np.concatenate([reps, np.broadcast_to(part.column(0).to_numpy(), (len(q), part.num_rows))], 1)
                if best.shape[1] > keep:
                    top = np.argpartition(-best, keep - 1, 1)[:, :keep]
                    best, reps = np.take_along_axis(best, top, 1), np.take_along_axis(reps, top, 1)
        at, k = np.nonzero(best >= floor[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(reps[at, k]), pa.array(best[at, k])], names=["query", "rep", "score"])

    return run


def _part_ratios(width: int, largest: float):
    """Neighbours ``(list, part, query, rep, vec)`` of one split list, with the query's vector, and the list's centroids -> the ratio at which the query opens the part."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        kind = pa.schema([("list", pa.int64()), ("query", pa.int64()), ("rep", pa.int64()), ("ratio", pa.float64())])
        if not rows.num_rows or not centres.num_rows:
            return kind.empty_table()
        order = np.argsort(centres.column("part").to_numpy(), kind="stable")
        c = _matrix(centres.column("centre").combine_chunks().take(pa.array(order)), width + 1)
        out = []
        for lo in range(0, rows.num_rows, 1024):
            some = rows.slice(lo, 1024)
            ratio = _ratios(_farness(_matrix(some.column("vec").combine_chunks(), width), c, largest), largest)
            out.append(ratio[np.arange(len(ratio)), some.column("part").to_numpy()])
        return pa.table([rows.column("list"), rows.column("query"), rows.column("rep"), np.concatenate(out)], schema=kind)

    return run


def _reaching(need: np.ndarray, weight: np.ndarray, share: float) -> float:
    """The least limit that so much of the weight needs at most."""
    order = np.argsort(need, kind="stable")
    total = np.cumsum(weight[order])
    return float(need[order][min(len(order) - 1, np.searchsorted(total, share * total[-1] - 1e-9))])


def _opening(asked: DataFrame, reps: DataFrame, posted: DataFrame, entries: DataFrame, centres: DataFrame | None, sample: np.ndarray, centroids: np.ndarray, largest: float, k: int) -> tuple[float, float, float]:
    """How many lists a query opens, within which ratio of the nearest one's distance, and the ratio for parts: as PROBED of the queries need it.

    These are compared with every entry. Their k nearest rows are looked up in the lists, and the limits are the least that reach
    PART_TARGET and TARGET of them; of number and ratio of lists the one counts that opens fewer entries.
    """
    n, width = len(centroids), sample.shape[1]
    if n == 1 and centres is None:
        return np.inf, np.inf, np.inf
    spark = asked.sparkSession
    picked = cut(asked.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id").limit(PROBED).groupBy(F.col("rep").alias("query")).agg(F.count("*").alias("times"), F.first("vec").alias("vec")), "sample-queries")
    few = picked.toArrow().combine_chunks()
    if not few.num_rows:
        return np.inf, np.inf, np.inf
    ids, times, q = few.column("query").to_numpy(), dict(zip(few.column("query").to_pylist(), few.column("times").to_pylist(), strict=True)), _matrix(few.column("vec").combine_chunks(), width)
    rough = q @ sample.T
    floor = np.full(len(q), -np.inf)
    if len(sample) > k:  # the sample bounds from below how near the k + 1 nearest entries are
        floor = np.partition(rough, -k - 1, 1)[:, -k - 1] - 1e-9 * (1 + np.abs(rough).max(1))
    forced = reps.select("rep", "vec").mapInArrow(_by_force(spark.sparkContext.broadcast((ids, q, floor)), width, k + 1), "query long, rep long, score double")
    best = forced.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1)
    true = cut(reps.select("rep", F.size("ids").alias("copies")).join(F.broadcast(best), "rep"), "sample-nearest")

    weight: dict[tuple[int, int], int] = {}
    left = dict.fromkeys(ids.tolist(), k)
    for r in true.orderBy("query", "n").collect():
        rows = min(left[r["query"]], r["copies"] - (r["query"] == r["rep"]))
        if rows > 0:
            weight[r["query"], r["rep"]] = rows * times[r["query"]]
            left[r["query"]] -= rows
    if not weight:
        return np.inf, np.inf, np.inf

    held = cut(entries.select("list", "rep").join(F.broadcast(true.select("query", "rep")), "rep"), "sample-lists")
    found = held.filter(F.col("list") < PART).select("list", "query", "rep", F.lit(1.0).alias("ratio"))
    if centres is not None:
        parts = held.filter(F.col("list") >= PART).select((F.shiftright("list", 32) - 1).alias("list"), (F.col("list").bitwiseAND(PART - 1) - 1).cast("int").alias("part"), "query", "rep")
        parts = parts.join(F.broadcast(picked.select("query", "vec")), "query")
        found = found.union(parts.groupBy("list").cogroup(centres.groupBy("list")).applyInArrow(_part_ratios(width, largest), "list long, query long, rep long, ratio double"))
    found = found.toArrow()
    pairs = {p: i for i, p in enumerate(weight)}
    at = np.array([pairs.get(p, -1) for p in zip(found.column("query").to_pylist(), found.column("rep").to_pylist(), strict=True)], int)
    lists, ratio, query = (found.column(c).to_numpy()[at >= 0] for c in ("list", "ratio", "query"))
    at, weights = at[at >= 0], np.array(list(weight.values()))

    def least(need: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), np.inf)
        np.minimum.at(out, at, need)
        return out

    part = _reaching(least(ratio), weights, PART_TARGET) * (1 + 1e-9)
    far = _farness(q, centroids, largest)
    row = np.searchsorted(ids, query, sorter=np.argsort(ids, kind="stable"))
    row = np.argsort(ids, kind="stable")[row]
    sizes = np.zeros(n)
    for r in posted.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    limits = []
    for measure, slack in ((_places(far) + 1.0, 0), (_ratios(far, largest), 1e-9)):
        limit = _reaching(least(np.where(ratio <= part, measure[row, lists], np.inf)), weights, TARGET) * (1 + slack)
        limits.append((float(((measure <= limit) * sizes).sum(1) @ [times[i] for i in ids.tolist()]), limit))
    (by_place, places), (by_ratio, within) = limits
    return (int(places), np.inf, part) if by_place <= by_ratio else (np.inf, within, part)


def _fit_parts(width: int, largest: float):
    """A sample of one list's entries with the list's number of parts -> the centroids of its parts."""

    def run(rows: pa.Table) -> pa.Table:
        x = _lifted(_matrix(rows.column("vec").combine_chunks(), width), largest)
        c = fit_centroids(x, min(len(x), rows.column("parts")[0].as_py()), rounds=8)
        return pa.table({"list": [rows.column("list")[0]] * len(c), "part": list(range(len(c))), "centre": list(c)}, schema=pa.schema([("list", pa.int64()), ("part", pa.int32()), ("centre", pa.list_(pa.float64()))]))

    return run


def _into_parts(width: int, largest: float, ratio: float, query: bool):
    """Rows of one list, or a block of them, and the list's centroids -> the same rows for each part within the ratio."""

    def run(rows: pa.Table, centres: pa.Table) -> pa.Table:
        names = [c for c in rows.column_names if c != "salt"]
        if not rows.num_rows or not centres.num_rows:
            return rows.select(names).slice(0, 0)
        order = np.argsort(centres.column("part").to_numpy(), kind="stable")
        c = _matrix(centres.column("centre").combine_chunks().take(pa.array(order)), width + 1)
        out = []
        for lo in range(0, rows.num_rows, 2048):
            part = rows.slice(lo, 2048)
            x = _matrix(part.column("vec").combine_chunks(), width)
            d = _farness(x, c, largest) if query else _distances(_lifted(x, largest), c)
            at, parts = np.nonzero((d == d.min(1, keepdims=True)) | (_ratios(d, largest) <= ratio) if query else _within(d, ratio))
            taken = part.take(pa.array(at)).select(names)
            taken = taken.set_column(names.index("list"), "list", pa.array((taken.column("list").to_numpy() + 1 << 32) + parts + 1, pa.int64()))
            if query:
                nearest = taken.column("first").to_numpy(zero_copy_only=False) & (parts == d.argmin(1)[at])
                taken = taken.set_column(names.index("first"), "first", pa.array(nearest))
            out.append(taken)
        return pa.concat_tables(out)

    return run


def _compare(width: int, keep: int):
    """Entries and queries of one block of a list -> the ``keep`` best entries of each query that are no worse than its ``least``."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        kind = pa.schema([("query", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not entries.num_rows or not queries.num_rows:
            return kind.empty_table()
        ids = entries.column("rep").to_numpy()
        x, y = (_matrix(t.column("vec").combine_chunks(), width) for t in (entries, queries))
        least = queries.column("least").to_numpy()
        out_q, out_r, out_s = [], [], []
        for lo in range(0, len(y), 256):
            rough = y[lo : lo + 256] @ x.T
            slack = 1e-9 * (1 + np.abs(rough).max(1))
            floor = least[lo : lo + 256] - slack
            if len(ids) > keep:
                floor = np.maximum(floor, np.partition(rough, -keep, 1)[:, -keep] - slack)
            for i, (row, f) in enumerate(zip(rough, floor, strict=True)):
                at = np.flatnonzero(row >= f)
                if not len(at):
                    continue
                score = (x[at] * y[lo + i]).sum(1)
                top = np.lexsort((ids[at], -score))[:keep]
                out_q.append(np.full(len(top), queries.column("query")[lo + i].as_py()))
                out_r.append(ids[at][top])
                out_s.append(score[top])
        return pa.table([np.concatenate(c) if c else [] for c in (out_q, out_r, out_s)], schema=kind)

    return run


def _met(entries: DataFrame, queries: DataFrame, width: int, keep: int) -> DataFrame:
    """``entries(list, rep, vec)`` and ``queries(list, query, least, vec)`` compared list by list, long ones in blocks."""
    long_, asked = cut(hot_keys(entries, "list", ENTRIES), "long-lists"), cut(hot_keys(queries, "list", QUERIES), "asked-lists")
    v = copied(dealt(entries, "list", long_, "rep").withColumnRenamed("salt", "block"), "list", asked)
    q = copied(dealt(queries, "list", asked, "query").withColumnRenamed("salt", "other"), "list", long_).withColumnRenamed("salt", "block").withColumnRenamed("other", "salt")
    keys = ["list", "block", "salt"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_compare(width, keep), "query long, rep long, score double")


def _part_centres(posted: DataFrame, width: int, largest: float, most: int) -> DataFrame | None:
    """``(list, part, centre)`` of the overfull lists, if there are any."""
    over = posted.groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT * most)
    over = cut(over.select("list", "n", F.ceil(F.col("n") / most).cast("int").alias("parts")), "overfull")  # at most as many as the first level has lists
    if over.isEmpty():
        return None
    few = posted.join(F.broadcast(over), "list").filter(F.pmod(F.xxhash64("rep", F.lit(3)), F.ceil(F.col("n") / PART_SAMPLE)) == 0)
    return cut(few.select("list", "parts", "vec").groupBy("list").applyInArrow(_fit_parts(width, largest), "list long, part int, centre array<double>"), "part-centres")


def _in_parts(rows: DataFrame, centres: DataFrame | None, width: int, largest: float, ratio: float, query: bool) -> DataFrame:
    """Entries or probes, those of split lists by part; part p of list k is list (k + 1) * 2**32 + p + 1."""
    if centres is None:
        return rows
    full = F.broadcast(centres.select("list").distinct())
    some = rows.join(full, "list", "left_semi")
    hot = cut(hot_keys(some, "list", QUERIES if query else ENTRIES), "split-lists")
    keys = ["list", "salt"]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    parts = dealt(some, "list", hot, "query" if query else "rep").select(*rows.columns, "salt").groupBy(*keys).cogroup(copied(centres, "list", hot).groupBy(*keys))
    return cut(rows.join(full, "list", "left_anti").union(parts.applyInArrow(_into_parts(width, largest, ratio, query), kind).select(*rows.columns)), "split-probes" if query else "split-entries")


def _balanced(posted: DataFrame, probes: DataFrame, width: int, largest: float, most: int, open_: float = OPEN) -> tuple[DataFrame, DataFrame]:
    """Entries and probes with overfull lists split into parts."""
    centres = _part_centres(posted, width, largest, most)
    return _in_parts(posted, centres, width, largest, CLOSURE, False), _in_parts(probes, centres, width, largest, open_, True)


def _numbers(vectors: DataFrame):
    """The embedding as it is stored if that is an array of floats (half the bytes), else as doubles."""
    return F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vec)`` of the vectors that take part: of the commonest length, all components finite, not all zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _numbers(vectors).alias("vec")).filter("vec_id is not null and size(vec) > 0")
    rows = rows.filter("forall(vec, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity')) and exists(vec, x -> x <> 0)")
    width = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vec") == (width["n"] if width else -1))


def nearest(vectors: DataFrame, wanted, k: int = NEAREST, size: int = LIST_SIZE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``: the k nearest found of each vector for which ``wanted`` holds.

    ``wanted`` is a condition on vec_id. Nearness is the inner product in double precision of the vectors as
    they are; equal scores go to the smaller vec_id; a query's own row is no candidate. Vectors that are null,
    zero, hold null or non-finite components, or differ in length from the commonest take no part; equal counts of lengths go to the shorter. A vec_id that repeats
    counts once, with the least of its usable vectors; a null vec_id takes no part. No vectors, or no queries, give no rows; fewer candidates than k give all that were found. Columns other than
    vec_id and embedding are ignored. ``size`` is the number of entries that a list should have.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(usable(vectors).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    first = rows.select("vec", "vec_id", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id")).alias("n")).filter(F.col("n") <= k + 1)
    reps = cut(first.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    norm = F.expr("aggregate(vec, 0D, (a, x) -> a + cast(x as double) * x)")
    facts = reps.agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.max(F.size("vec")).alias("width")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, largest = facts["width"], max(facts["largest"], 1e-300)
    sample = reps.select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
    x = _lifted(_matrix(sample, width), largest)
    lists = max(1, min(MAX_LISTS, len(x), -(-facts["n"] // size)))
    centroids = fit_centroids(x, lists)
    shared = spark.sparkContext.broadcast((centroids, largest))
    kind = reps.schema["vec"].dataType.simpleString()

    posted = cut(reps.select("rep", "vec").mapInArrow(_post(shared, width), f"list long, rep long, vec {kind}"), "lists")
    asked = cut(rows.filter(wanted).join(reps.select("vec", "rep"), "vec").select("vec_id", "rep", "vec"), "queries")
    distinct = asked.groupBy(F.col("rep").alias("query")).agg(F.first("vec").alias("vec"))
    centres = _part_centres(posted, width, largest, size)
    entries = _in_parts(posted, centres, width, largest, CLOSURE, False)
    places, within, part = _opening(asked, reps, posted, entries, centres, x[:, :-1], centroids, largest, k)
    probed = f"list long, first boolean, turn int, query long, vec {kind}"
    probes = cut(distinct.mapInArrow(_probe(shared, width, places, within), probed), "probes")
    probes = _in_parts(probes, centres, width, largest, part, True)

    order = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best_of = lambda met: met.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n")
    near = cut(_met(entries, probes.filter("first").select("list", "query", F.lit(float("-inf")).alias("least"), "vec"), width, k + 1), "nearest-lists")
    for turn in range((probes.agg(F.max("turn")).first()[0] or 0) + 1):  # what was found so far bounds what a list may add
        some = f"not first and turn = {turn}"
        if probes.filter(some).isEmpty():
            continue
        near = best_of(near)
        least = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("least"))
        others = probes.filter(some).join(least, "query", "left").select("list", "query", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "vec")
        near = cut(near.union(_met(entries, others, width, k + 1)), "nearer-lists")
    near = cut(best_of(near), "nearest-found")
    limit, everything = LEAST_LISTS if np.isinf(places) else max(places, LEAST_LISTS), len(centroids) == 1 and centres is None
    while not everything:  # a query with too few entries in its lists opens more, all of them at last
        short = distinct.join(near.groupBy("query").count(), "query", "left").filter(F.coalesce("count", F.lit(0)) < min(k + 1, facts["n"]))
        short = cut(short.select("query", "vec"), "short-queries")
        if short.isEmpty():
            break
        limit *= GROWTH
        everything = limit >= len(centroids)
        more = cut(short.mapInArrow(_probe(shared, width, limit, np.inf), probed), "more-probes")
        more = _in_parts(more, centres, width, largest, np.inf, True).select("list", "query", F.lit(float("-inf")).alias("least"), "vec")
        near = cut(best_of(near.union(_met(entries, more, width, k + 1))), "nearest-found")
    wide = near.join(reps.select("rep", "ids"), "rep").groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    # at most (k + 1) entries of k + 1 ids for each distinct query
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).join(wide, "query").select(
        "query_id", F.expr(f"slice(array_sort(filter(flatten(transform(near, e -> transform(e.ids, i -> struct(-e.score as less, i as vec_id)))), c -> c.vec_id <> query_id)), 1, {k})").alias("near")
    )
    return pairs.select("query_id", F.posexplode("near").alias("pos", "c")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.less")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
