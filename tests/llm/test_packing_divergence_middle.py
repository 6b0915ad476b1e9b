"""Packing, divergence and fill-in-middle: the library's ids, brute force, and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from costlens.llm import op11_packing, op12_divergence, op13_fill_middle

from .test_text_operators import frame

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "It's I'LL we've don't '' '.", "<|endoftext|>x<|EndOfText|> <|endoftext", "J̌ ǰ ≠ é", "İİ ΣΑΣ ß", "….. “word”. word…, 10 0 00 x0,", "\x1c\x1d\x85  x　y", "日本語テキスト。 text", "\x00a\x00 b", "word. word, WORD! Word?"]


# ---- 11. packing


def check_packing(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def pack_by_force(lengths, capacity):
    """Sequences that the method needs, one piece at a time: large pieces with the longest large one that fits, then best fit, longest first."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), 0)
        if b:
            large.remove(b)
        gaps.append(capacity - a - b)
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_the_method_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 2, 3, 10, 37, 100])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randrange(200))]
    plan = op11_packing.Plan(dict(Counter(lengths)), capacity)
    assert plan.sequences == pack_by_force(lengths, capacity)
    filled, placed = defaultdict(list), Counter()
    for (length, first, sequence, offset, each), left in zip(sorted(plan.runs), [*sorted(plan.runs)[1:], None], strict=True):
        last = left[1] if left and left[0] == length else Counter(lengths)[length]
        assert first == placed[length]
        for nth in range(last - first):
            filled[sequence + nth // each].append((offset + nth % each * length, length))
        placed[length] = last
    assert placed == Counter(lengths)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_plan_of_a_million_million_pieces_is_short():
    plan = op11_packing.Plan({n: 10**12 // n for n in range(1, 4097)}, 4096)
    assert len(plan.runs) < 50_000


def test_ids_are_those_of_the_library(spark):
    path = public_tokenizers.path(op11_packing.VOCABULARY)
    library, rng = Tokenizer.from_file(path), random.Random(3)
    texts = [*ODD, *("".join(rng.choice("aeinrstoéJ̌́ \n0128.,'<|>") for _ in range(rng.randrange(200))) for _ in range(200)), " ".join(f"word{rng.randrange(3000)}" for _ in range(20_000)), "x" * 300_000, "many words, " * 120_000]
    docs = frame(spark, enumerate(texts)).union(frame(spark, [(1, "a"), (None, "b c"), (None, "b c")])).withColumnRenamed("source", "offset").withColumnRenamed("lang", "nth")
    rows = op11_packing.pieces(docs, path, "doc_id").collect()
    want = Counter()
    for i, t in [*enumerate(texts), (1, "a"), (None, "b c"), (None, "b c")]:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.update((i, k, at, np.array(ids[at : at + 4096], "<u4").tobytes()) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == want
    assert all(r["length"] * 4 == len(r["ids"]) for r in rows)


def test_pieces_are_packed_and_joined(spark):
    path = public_tokenizers.path(op11_packing.VOCABULARY)
    docs = frame(spark, [(i, "some words here. " * (i % 70)) for i in range(400)] + [(7, "x"), (7, "x"), (None, None)]).repartition(5)
    made = op11_packing.pieces(docs, path, "doc_id", capacity=100)
    packed = op11_packing.pack(made, capacity=100).cache()
    rows = packed.collect()
    lengths = [r["length"] for r in rows]
    assert Counter((r["doc_id"], r["piece"]) for r in rows) == Counter((r["doc_id"], r["piece"]) for r in made.collect())
    assert check_packing(rows, 100) == pack_by_force(lengths, 100)
    joined = op11_packing.sequences(packed, "doc_id", "piece").collect()
    ids = defaultdict(dict)
    for r in rows:
        ids[r["sequence_id"]][r["offset"]] = bytes(r["ids"])
    assert {r["sequence_id"]: bytes(r["ids"]) for r in joined} == {s: b"".join(x for _, x in sorted(parts.items())) for s, parts in ids.items()}
    assert sum(len(r["pieces"]) for r in joined) == len(rows) and all(r["n_tokens"] <= 100 for r in joined)


def test_equal_lengths_are_numbered_over_all_tasks(spark):
    docs = frame(spark, [(i, None) for i in range(10_000)]).repartition(7)
    rows = op11_packing.pack(op11_packing.pieces(docs, public_tokenizers.path(op11_packing.VOCABULARY), "doc_id")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 10_000 and check_packing(rows) == 3


def test_packing_edges(spark):
    path = public_tokenizers.path(op11_packing.VOCABULARY)
    assert op11_packing.pack(op11_packing.pieces(frame(spark, []), path, "doc_id")).count() == 0
    exact = frame(spark, [(1, "a " * 4095), (2, "a " * 4096), (3, "a " * 8191)])
    rows = op11_packing.pack(op11_packing.pieces(exact, path, "doc_id")).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == [(1, 0, 0, 4096), (2, 0, 0, 4096), (2, 1, 4096, 1), (3, 0, 0, 4096), (3, 1, 4096, 4096)]
    with pytest.raises(ValueError, match="long"):
        op11_packing.pack(op11_packing.pieces(exact, path, "doc_id"), capacity=100)


def test_packing_query(spark):
    library = Tokenizer.from_file(public_tokenizers.path(op11_packing.VOCABULARY))
    rows = op11_packing.query(spark, DATA).collect()
    want = set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want |= {(r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert check_packing(rows) == pack_by_force([r["length"] for r in rows], 4096)


# ---- 12. divergence


def divergence_by_force(docs, min_docs, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    n, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        n[(lang or "", source or "")].update(words(text))
        seen[lang or ""].update(set(words(text)))
    out = []
    for lang in {g[0] for g in n}:
        kept = [t for t, k in seen[lang].items() if k >= min_docs]
        groups = {s: n[(g, s)] for g, s in n if g == lang}
        total = sum(groups.values(), Counter())

        def p(counts, t, kept=kept):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept) + 5 * len(kept))

        for s, c in groups.items():
            pair = [(sum(abs(p(c, t) - p(d, t)) for t in kept), o) for o, d in groups.items() if o != s]
            term = [(p(c, t) - p(total, t), t) for t in kept if c[t] and p(c, t) > p(total, t)]
            for part, rows, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def some_docs(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [*(f"{a}{b}" for a in "bcdfgé" for b in ("a", "o", "ü", "ei")), "Zed", "zed", "\U0001f600"]
    return [(rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(60)))]) if k % 9 == 0 else " ".join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randrange(60))) + ", 12 x-y", rng.choice(["en", "en", "en", "de", None, ""]), rng.choice([None, "", *"abcdefghijk"])) for k in range(n)]


@pytest.mark.parametrize(("seed", "block", "tile"), [(1, 4096, 64), (2, 5, 3), (3, 1, 1)])
def test_divergence_by_force(spark, seed, block, tile):
    docs = some_docs(seed)
    docs += docs[:20]
    table = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in docs], "text string, lang string, source string, value int, term string")
    got = op12_divergence.divergence(table, min_docs=5, top_terms=7, block=block, tile=tile).collect()
    assert sorted(map(tuple, got)) == divergence_by_force(docs, 5, 7)


def test_divergence_edges(spark):
    table = lambda rows: spark.createDataFrame(rows, "text string, lang string, source string")
    assert op12_divergence.divergence(table([])).count() == 0
    no_terms = [("a b", "en", "x"), (None, "en", "y"), ("", "en", "z"), ("only one source", "de", "x")]
    got = op12_divergence.divergence(table(no_terms)).collect()
    assert sorted(map(tuple, got)) == divergence_by_force(no_terms, 30, 50) and len(got) == 6 and {r["value"] for r in got} == {0}
    long = [("Word wOrd other " * 200_000, "en", "x"), ("word " * 5, "en", "y")] + [("word", "en", "y")] * 30 + [("z" * 3_000_000, "en", "x")]
    got = op12_divergence.divergence(table(long)).collect()
    assert sorted(map(tuple, got)) == divergence_by_force(long, 30, 50)


def test_trees_share_equal_subtrees():
    counts = np.zeros((50, 1024), np.int64)
    counts[7, 3] = 5
    trees = op12_divergence.Trees(counts)
    assert all(len(first) <= 2 for first, _ in trees.levels) and len(set(trees.roots)) == 2
    left, right = np.array([0, 0]), np.array([1, 7])
    totals = np.where(np.arange(50) == 7, 5, 0)
    p = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * 1024)
    assert trees.prices(left, right, totals, 1024).tolist() == [0, abs(p(5, 5) - p(0, 0)) + 1023 * abs(p(0, 5) - p(0, 0))]


def test_billionths_are_exact():
    rng = random.Random(4)
    for _ in range(2000):
        total = rng.randrange(10 ** rng.randrange(1, 15))
        n, kept = rng.randrange(total + 1), rng.randrange(1, 10**6)
        assert op12_divergence._billionths(np.array([n]), np.array([total]), kept)[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


def test_map_tasks_hand_on_what_they_hold(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(26)), "en", "s") for j in range(26)], "text string, lang string, source string")
    want = {("en", "s", None): (0, 0)} | {("en", "s", f"t{chr(97 + i)}{chr(97 + j)}"): (1, 1) for i in range(26) for j in range(26)}
    monkeypatch.setattr(op12_divergence, "HELD_TERMS", 10)
    got = op12_divergence.term_counts(docs).collect()
    assert {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in got} == want


# ---- 13. fill-in-middle


def middle_by_force(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, None)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (i, len(units), "plain", None, None, text)
    spm = h4 % 100 < spm
    return (i, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def test_middle_by_force_and_back(spark):
    rng = random.Random(5)
    texts = [*ODD, "\n", "\n\n\n", "a\n\n", "\na", "<P>", "x<M>\n", "<<S", "<\n<P\n>S>", "\r\n\r", "😀\né\n日本", "<" * 9 + "\n" + ">" * 9, *("".join(rng.choice("a<PSM>\n é😀") for _ in range(rng.randrange(60))) for _ in range(300))]
    rows = [*enumerate(texts), (1, "a\nb\nc"), (1, "a\nb\nc"), (None, "x\ny\n"), (-5, "x\ny\n")]
    docs = frame(spark, rows).withColumnRenamed("lang", "h1").withColumnRenamed("source", "form").repartition(3)
    for rate, spm in ((100, 50), (50, 0), (100, 100)):
        made = op13_fill_middle.fill_in_middle(docs, "doc_id", rate=rate, spm_rate=spm)
        got = made.withColumn("back", op13_fill_middle.restored()).collect()
        assert Counter(tuple(r)[:-1] for r in got) == Counter(middle_by_force(i, t, 7, rate, spm) for i, t in rows)
        assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in rows)


def test_middle_of_long_texts(spark):
    rows = [(1, "line\n" * 500_000), (2, "x" * 5_000_000), (3, "\n" * 300_000 + "end")]
    got = op13_fill_middle.fill_in_middle(frame(spark, rows), "doc_id").withColumn("back", op13_fill_middle.restored()).collect()
    assert sorted(tuple(r)[:-1] for r in got) == [middle_by_force(i, t) for i, t in rows]
    assert {r["doc_id"]: r["back"] for r in got} == dict(rows)


def test_middle_edges(spark):
    assert op13_fill_middle.fill_in_middle(frame(spark, []), "doc_id").count() == 0
    clash = spark.createDataFrame([(1, "a\nb", "kept")], "doc_id long, text string, _id string")
    assert op13_fill_middle.fill_in_middle(clash, "doc_id", "_id").first()["_id"] == "kept"
    with pytest.raises(Exception, match="cover"):
        op13_fill_middle.fill_in_middle(frame(spark, [(1, "a b")]), "doc_id", units=r"(a)*").collect()


@pytest.mark.parametrize("module", [op12_divergence, op13_fill_middle])
def test_queries_are_their_sql(spark, module):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = module.query(spark, DATA)
    want = duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'; {module.ORACLE_SQL}").df()
    a = got.toPandas()[sorted(got.columns)].astype(object)
    b = want[sorted(want.columns)].astype(object)
    plain = lambda d: sorted((tuple("" if v is None or v != v else str(int(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in d.itertuples(index=False)))
    assert list(a.columns) == list(b.columns) and plain(a) == plain(b) and docs.count() > 0
