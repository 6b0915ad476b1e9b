"""Quality, vectors, URLs and the pipeline: held-out accuracy, recall and brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from costlens.llm import op3_quality, op4_posting_lists, op6_language, op10_url_rules
from costlens.llm import queries as registered

from .test_text_operators import SCHEMA, components_by_force, frame, hits_by_force, repeats_by_force, words_text

DATA = "/root/testdata/sf0.01"


# ---- 3. quality


def test_quality_on_held_out_labels(spark):
    got = op3_quality.query(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").select("quality", "predicted", "score").toPandas()
    assert len(got) > 50 and (got["quality"] == got["predicted"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = op3_quality.learn(frame(spark, [(1, "good words here"), (2, "x"), (3, None)]), labels, sample=10)
    docs = frame(spark, [(1, None), (2, ""), (3, "a " * 20_000), (3, "a " * 20_000), (4, "%%% &&&")]).withColumnRenamed("source", "score")
    rows = op3_quality.quality(docs, model, "doc_id").collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    nothing = op3_quality.learn(frame(spark, []), labels.limit(0))
    assert [r["score"] for r in op3_quality.quality(frame(spark, [(1, "a")]), nothing, "doc_id").collect()] == [0.5]
    assert op3_quality.quality(frame(spark, []), nothing, "doc_id").count() == 0


def test_sample_keeps_its_bound(spark):
    docs = spark.range(50_000).selectExpr("7L as doc_id", "concat('text ', id) as text").union(spark.range(100, 160).selectExpr("id", "concat('x ', id)"))
    labels = docs.selectExpr("doc_id", "1 as quality")
    good, some = op3_quality.sampled(docs, labels, 10)
    assert len(good) == len(some) == 10
    good, some = op3_quality.sampled(docs, labels, 100)
    assert len(good) == len(some) == 61  # every id once


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_prior_of_a_known_mixture(share):
    rng = np.random.default_rng(1)
    draw = lambda good, n: rng.normal(1.5 if good else -1.5, 1, (n, 4))
    mixed = np.concatenate([draw(True, int(4000 * share)), draw(False, int(4000 * (1 - share)))])
    assert abs(op3_quality.class_prior(draw(True, 4000), rng.permutation(mixed)) - share) < 0.06


def figures_by_force(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), re.findall(r"[^\n\r]+", text)
    if not words:
        return [0.0] * 15
    w, b = len(words), sum(len(x.encode()) for x in words)
    marks, symbol = set(".,;:?'\"()-"), lambda c: "!" <= c <= "~" and not c.isalnum() and c not in ".,;:?'\"()-"
    up, low = [sum("A" <= c <= "Z" for c in x) for x in words], [sum("a" <= c <= "z" for c in x) for x in words]
    symbols = [sum(map(symbol, x)) for x in words]
    assert not any(symbol(c) for c in marks)
    return [
        math.log1p(w), b / w / 10, sum(len(x.encode()) <= 2 for x in words) / w, len(set(words)) / w, sum(x == y for x, y in zip(words, words[1:], strict=False)) / w,
        max(map(words.count, words)) / w, sum(symbols) / b, sum(n > 0 for n in symbols) / w, sum(up) / max(1, sum(up) + sum(low)), sum(u > 1 and not n for u, n in zip(up, low, strict=True)) / w,
        sum(x.count("!") for x in words) / w, sum("0" <= c <= "9" for x in words for c in x) / b, math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(sum(c > 127 for c in x.encode()) for x in words) / b,
    ]


def test_scores_by_force(spark):
    rng = random.Random(4)
    texts = ["", " \n ", "Hello, World! HELLO hello hello\nline\nline\n\r", "é漢字 #1 $$ 2024 a b", *("".join(rng.choice("aB 1!.#é\n") for _ in range(rng.randrange(80))) for _ in range(60)), "word " * 30_000]
    got = [x for _, part in op3_quality.features(pa.array(texts)) for x in part]
    assert np.allclose(got, [figures_by_force(t) for t in texts])
    n = len(op3_quality.FEATURES)
    model = {"mean": np.linspace(0, 1, n), "scale": np.linspace(1, 2, n), "w": np.linspace(-1, 1, 2 * n + 1)}
    for r in op3_quality.quality(frame(spark, enumerate([*texts, None])), model, "doc_id").collect():
        x = (np.array(figures_by_force((texts + [""])[r["doc_id"]])) - model["mean"]) / model["scale"]
        z = sum(a * b for a, b in zip([*x, *np.sqrt(abs(x)), 1], model["w"], strict=True))
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-40, min(40, z))))) < 1e-9


def test_risk_needs_no_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (1500, 4)), rng.normal(-1.5, 1, (1500, 4))
    model = op3_quality.fit_risk(good[:700], np.concatenate([good[700:], bad[:800]]), 0.5)
    score = lambda x: op3_quality._expand((x - model["mean"]) / model["scale"]) @ model["w"] > 0
    assert score(good).mean() > 0.95 and score(bad[800:]).mean() < 0.05


# ---- 4. vectors


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        x = np.array(dict(rows)[q], float)
        scored = sorted((-float((np.array(v, float) * x).sum()), i) for i, v in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1200)]
    rows += [(i, rows[5][1]) for i in range(2000, 2400)]  # a quarter of all rows is one vector
    odd = [(3000, None), (3001, [0.0] * 8), (3002, [1.0] * 7 + [float("nan")]), (3003, [1.0] * 7 + [None]), (3004, [1.0, 2.0]), (3005, [])]
    vectors = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *odd, rows[40]]], "vec_id long, embedding array<float>, score int")
    got = op4_posting_lists.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    queries = [i for i, _ in rows if i % 20 == 0]
    want = brute_nearest(rows, queries, 20)
    assert set(found) == set(queries) and all(len(v) == 20 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in queries]) >= 0.9
    assert found[2000] == want[2000]  # among equal vectors the smaller ids come first
    scores = {(r["query_id"], r["rank"]): r["score"] for r in got}
    assert all(scores[q, k] >= scores[q, k + 1] for q in queries for k in range(1, 20))


def recall(got, want):
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return np.mean([len(set(found[q]) & set(want[q])) / len(want[q]) for q in want])


@pytest.mark.parametrize("n", [600, 1500, 4000])
def test_recall_in_dense_regions(spark, n):
    """Nine tenths of all vectors lie in one narrow cone."""
    rng = np.random.default_rng(n)
    dense = np.array([4.0] + [0.0] * 15) + rng.normal(size=(n * 9 // 10, 16)) * 0.3
    x = np.concatenate([dense, rng.normal(size=(n - len(dense), 16)) * 3])
    rows = [(i, [float(np.float32(c)) for c in v / np.sqrt((v * v).sum())]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op4_posting_lists.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    assert recall(got, brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)) >= 0.9


def uneven(kind):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 16))
    if kind == "norms":
        return x * np.exp(1.5 * rng.normal(size=(len(x), 1)))
    if kind == "sparse":
        return x * (rng.random(x.shape) < 0.15) + 1e-6
    if kind == "huge and tiny":
        x[7] *= 1e12
        return x * 1e-14
    # one in twenty of the rows, those asked for, lies spread out beside tight heaps
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, len(x))] * 3 + x * 0.02
    x[::20] = rng.normal(size=x[::20].shape) * 2
    return x


@pytest.mark.parametrize("kind", ["norms", "sparse", "huge and tiny", "queries apart"])
def test_recall_over_many_lists_of_uneven_rows(spark, kind):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(uneven(kind))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op4_posting_lists.nearest(vectors, F.col("vec_id") % 20 == 0, size=20).collect()
    assert len(got) == len(rows) // 20 * 20  # every query has its 20 rows
    assert recall(got, brute_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)) >= 0.9


def test_overfull_lists_are_split(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 6))
    posted = spark.createDataFrame([(i % 7 and 1, i, [float(v) for v in row]) for i, row in enumerate(x)], "list long, rep long, vec array<double>")
    probes = spark.createDataFrame([(1, True, 5000, [float(v) for v in x[3]]), (0, False, 5000, [float(v) for v in x[3]])], "list long, first boolean, query long, vec array<double>")
    entries, asked = op4_posting_lists._balanced(posted, probes, 6, float((x * x).sum(1).max()), 50)
    sizes = {r["list"]: r["count"] for r in entries.groupBy("list").count().collect()}
    assert sizes[0] == 129 and len(sizes) > 8 and max(sizes.values()) <= 200
    assert {r["rep"] for r in entries.collect()} == set(range(900))
    opened = asked.collect()
    assert sum(r["first"] for r in opened) == 1 and {0, *(r["list"] for r in opened)} <= set(sizes)


def test_search_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert op4_posting_lists.nearest(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0])], kind)
    assert [tuple(r) for r in op4_posting_lists.nearest(few, F.col("vec_id") == 1).collect()] == [(1, 1, 2, 0.5)]
    assert op4_posting_lists.nearest(few.limit(1), F.lit(True)).count() == 0


def test_neighbours_of_a_repeated_id(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(20, (rng.normal(size=8) - 9).tolist()), (20, (rng.normal(size=8) + 9).tolist()), (40, rows[40][1]), (None, [1.0] * 8)]
    kind = "vec_id long, embedding array<float>"
    got = op4_posting_lists.nearest(spark.createDataFrame(rows, kind), F.col("vec_id") % 20 == 0).toPandas()
    assert got.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 200, 20), 20) and not got.duplicated(["query_id", "rank"]).any()
    least = {}
    for i, v in rows[:-1]:
        v = tuple(np.float32(v).astype(float))
        least[i] = min(v, least.get(i, v))
    x = np.array([least[i] for i in range(200)])
    for q in range(0, 200, 20):
        want = sorted((-float(x[q] @ x[i]), i) for i in range(200) if i != q)[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(set(mine.vec_id) & {i for _, i in want}) >= 18 and np.allclose([x[q] @ x[i] for i in mine.vec_id], mine.score)


# ---- 10. URLs


def test_given_rules_and_parts_of_urls(spark):
    urls = {
        1: "http://A.Example.NET/en/1?x=/de/", 2: "https://example.com/de/", 3: "https://badexample.com/de/", 4: "http://x.org/fr/2#t", 5: "http://x.net", 6: "net/", 7: None, 8: "",
        9: "http://net/", 10: "ftp://h?q://z/", 11: "http://a.example.net/EN/", 12: "a://b://c/d",
    }
    pages = spark.createDataFrame([*urls.items(), (1, urls[1])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op10_url_rules.filter_urls(pages).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("example.com", "/de/", "example.com/de/", "block")
    assert got[3][2] is None and got[4][2:] == ("org/fr/", "allow") and got[5][:3] == ("x.net", "", None) and got[6] == ("", "", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("net/", "block") and got[10][:2] == ("h", "") and got[11][2:] == ("net/", "block") and got[12][:2] == ("b:", "//c/d")
    assert op10_url_rules.filter_urls(pages).count() == len(urls) + 1
    assert op10_url_rules.filter_urls(pages.limit(0)).count() == 0


def test_mined_rules_decide_the_rest(spark):
    rows = [(i, f"http://s{i}.net/{'pills' if i % 2 else 'x'}/{i}") for i in range(40)] + [(100 + i, f"http://s{i}.org/fr/{'pills' if i == 0 else 'news'}/{i}") for i in range(40)]
    rows += [(200, "http://a.com/pills/1"), (201, "http://a.com/fr/news/2")]
    got = {r["page_id"]: r["verdict"] for r in op10_url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == "block" and got[201] == "allow"
    labelled = spark.createDataFrame([(["a", "b"], "block")] * 8 + [(["a"], "allow")] * 8 + [(["b", "c"], "block")] * 2, "tokens array<string>, verdict string")
    mined = {(tuple(r["left"]), r["verdict"]): (r["confidence"], r["key"]) for r in op10_url_rules.mine(labelled, 0.01, 0.8).collect()}
    assert mined == {(("b",), "block"): (1.0, "b"), (("c",), "block"): (1.0, "c")}


def rules_by_force(rows, support, confidence):
    """All rules of the labelled token sets, as the docstring of the module has them."""
    n, found = len(rows), {}
    tokens = sorted({t for ts, _ in rows for t in ts})
    for size in range(1, len(tokens) + 1):
        for left in itertools.combinations(tokens, size):
            own = [v for ts, v in rows if set(left) <= set(ts)]
            for v in set(own):
                if own.count(v) / n >= support and own.count(v) / len(own) >= confidence:
                    found[left, v] = (own.count(v) / len(own), own.count(v) / n)
    worse = lambda left, v: any(found.get((tuple(t for t in left if t != x), v), (0, 0))[0] >= found[left, v][0] for x in left)
    return {k: f for k, f in found.items() if not worse(*k)}


def test_rules_and_verdicts_by_force(spark):
    rng = random.Random(31)
    parts = ["pills", "news", "win", "a", "b"]
    url = lambda end: f"http://{rng.choice(['s', 't'])}{end}/" + "/".join(rng.choice(parts) for _ in range(rng.randrange(1, 3)))
    urls = [url(".net") for _ in range(60)] + [url(".org") for _ in range(20)] + [f"http://{rng.choice('st')}.org/fr/{rng.choice(parts)}" for _ in range(40)] + [url(".com") for _ in range(60)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = op10_url_rules.host_and_path()
    told = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("*", op10_url_rules.url_tokens().alias("tokens"), op10_url_rules.given_rule(op10_url_rules.RULES).alias("g")).collect()
    labelled = [(r["tokens"], r["g"]["verdict"]) for r in told if r["g"]]
    rules = rules_by_force(labelled, 0.05, 0.8)
    frame_ = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    got = {(tuple(r["left"]), r["verdict"]): (r["confidence"], r["support"]) for r in op10_url_rules.mine(frame_, 0.05, 0.8).collect()}
    assert got.keys() == rules.keys() and all(np.allclose(got[k], rules[k]) for k in got)

    def verdict(r):
        if r["g"]:
            return r["g"]["verdict"]
        fits = [(f[0], f[1], -len(left), v) for (left, v), f in rules.items() if set(left) <= set(r["tokens"])]
        return max(fits)[3] if fits else "allow"

    assert {r["page_id"]: r["verdict"] for r in op10_url_rules.filter_urls(pages, support=0.05).collect()} == {r["page_id"]: verdict(r) for r in told}


# ---- 6. languages, whole


def languages_by_force(train, texts):
    """The docstring's method, a word and a byte at a time."""
    words = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))]
    script = lambda w: op6_language.RANGES[max(i for i, (x, _) in enumerate(op6_language.RANGES) if x <= ord(w.decode()[0]))][1]
    grams = lambda w: [(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for a, b, c in zip(b" " + w, w, w[1:] + b" ", strict=False)]
    langs = sorted({lang for _, lang in train})
    count, writes = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, lang in train:
        for w in words(t):
            count[lang].update(grams(w))
            writes[lang][script(w)] += 1
    total = {x: sum(count[x].values()) for x in langs}
    log = lambda x, g: float(np.float32(math.log((count[x][g] + 0.5) / (total[x] + 0.5 * 65536))))
    out = []
    for t in texts:
        ws = words(t)
        scores = []
        for w in ws:
            own = {x: sum(log(x, g) for g in grams(w)) for x in langs}
            ok = {x for x in langs if writes[x][script(w)] >= 0.002 * max(1, sum(writes[x].values()))} or set(langs)
            least = min(own.values()) - 50
            scores.append([own[x] if x in ok or not any(writes[y][script(w)] for y in langs) else least for x in langs])
        best, back = list(scores[0]) if scores else [], []
        for row in scores[1:]:
            top = max(range(len(langs)), key=lambda k: best[k])
            back.append([k if best[k] >= best[top] - op6_language.SWITCH else top for k in range(len(langs))])
            best = [max(best[k], best[top] - op6_language.SWITCH) + row[k] for k in range(len(langs))]
        if not scores:
            out.append(("und", 0.0))
            continue
        at = max(range(len(langs)), key=lambda k: best[k])
        labels = [at]
        for row in reversed(back):
            labels.append(row[labels[-1]])
        share = [sum(len(w) for w, k in zip(ws, reversed(labels), strict=True) if k == x) for x in range(len(langs))]
        out.append((langs[share.index(max(share))], max(share) / sum(share)))
    return out


def test_languages_by_force(spark):
    rng = random.Random(41)
    letters = {"aa": "abcde fg", "bb": "bcdxyz é", "cc": "жзик лм"}
    text = lambda lang, n: "".join(rng.choice(letters[lang]) for _ in range(n))
    train = [(text(lang, 200), lang) for lang in letters for _ in range(6)]
    texts = [text(rng.choice("a b c".split()) * 2, 60) + " " + text(rng.choice("a b c".split()) * 2, 60) for _ in range(40)] + ["", "12 34", "Ω"]
    docs = spark.createDataFrame([(t, lang) for t, lang in train], "text string, lang string")
    got = {r["i"]: (r["lang_pred"], r["score"]) for r in op6_language.languages(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), op6_language.learn(docs), "i").collect()}
    want = languages_by_force(train, texts)
    assert sum(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-9 for i, w in enumerate(want)) == len(texts)


# ---- the pipeline


def test_pipeline_by_force(spark, tmp_path):
    rng = random.Random(21)
    passage, bench = words_text(rng, 50), words_text(rng, 30)
    texts = [words_text(rng, 60) for _ in range(8)]
    texts += [texts[0], texts[1] + " more", texts[2] + " " + passage, texts[3] + " " + passage, "", None, "123 456 !!!", bench, texts[4][:40] + " " + bench]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "sentencepiece"]
    held = {r["doc_id"] for r in docs.filter(op6_language.held_out()).collect()}
    assert held and len(held) < len(texts)

    left = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in stages["language_id"](spark, docs, str(tmp_path)).collect()) == [i for i, _ in left]
    classes = components_by_force(left)
    left = [(i, t) for i, t in left if classes[i] == i]
    left = list(zip([i for i, _ in left], [rest for _, _, rest in repeats_by_force([t for _, t in left], 35)], strict=True))
    want = {}
    for i, t in left:
        n, hit, _ = hits_by_force(t, [(1, bench)])
        if not (hit and 20 * hit >= n):
            want[i] = t
    after = stages["near_dedup"](spark, stages["language_id"](spark, docs, str(tmp_path)), str(tmp_path))
    cut = {r["doc_id"]: " ".join(r["text"].split()) for r in stages["substring_dedup"](spark, after, str(tmp_path)).collect()}
    assert cut == dict(left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(want) and all(r["round_trip"] for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    kept = {r["doc_id"]: r["text"] for r in stages["substring_dedup"](spark, after, str(tmp_path)).collect()}
    assert {r["doc_id"]: r["n_pieces"] for r in got} == {i: len(library.encode(kept[i])) for i in want}


def test_stages_keep_the_documents_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, words_text(random.Random(i), 40), "en", "s", 9, "x", i) for i in range(6)], SCHEMA + ", component_id string, hit int")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 6, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", ["op1_minhash", "op2_licenses", "op8_decontaminate", "op9_substrings"])
def test_queries_are_their_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    got, want = registered.queries()[name](spark, data).toPandas(), c.sql(registered.oracle_sql()[name]).df()
    plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    assert [tuple(map(str, r)) for r in plain(got)] == [tuple(map(str, r)) for r in plain(want)]
