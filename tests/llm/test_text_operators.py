"""The corpus operators on texts against brute force, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import public_tokenizers
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from costlens.llm import common, op1_minhash, op2_licenses, op5_sentencepiece, op6_language, op7_token_counts, op8_decontaminate, op9_substrings, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts], SCHEMA)


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("kept,pattern,low", [(words.SPACED, r"[^\x20\x09-\x0D]+", False), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_words_of_pieces(monkeypatch, kept, pattern, low, size):
    texts = ["Hello wOrld  foo", "", None, " a b\n", "héé ß\x85x c 漢", "x", "  ", "\x00\x01a-b"]
    monkeypatch.setattr(words, "PIECE_BYTES", size)
    got = []
    for p in words.pieces(pa.array(texts), kept, low):
        w = [bytes(p.data[a:b]).decode() for a, b in zip(p.starts, p.ends, strict=True)]
        got += [w[p.first[i] : p.first[i + 1]] for i in range(p.hi - p.lo)]
    assert got == [re.findall(pattern, lower(t) if low else t or "") for t in texts]


def test_window_hashes_depend_on_words_alone():
    p = next(words.pieces(pa.array(["a b c d a b c", "x a b c d"]), words.SPACED, False))
    h = words.windows(p.hashes(), 3)
    assert h[0] == h[4] == h[8] and len({int(x) for x in h[[0, 1, 2, 3]]}) == 4


# ---- 1. near-duplicates


def components_by_force(texts, width=5, percent=75):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for s, t in itertools.product(sets[a], sets[b]):
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_by_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = words_text(rng, rng.choice([6, 40, 120]))
        texts += [base] * rng.choice([1, 3]) + [edited(rng, base, k) for k in (1, 1, 2, 3, 5, 9)]
    hot = words_text(rng, 150)
    texts += [edited(rng, hot, 4) for _ in range(60)] + ["", None, " \n", "one two", "One  two", "a b c d", "a b c d e"]
    rows = list(enumerate(texts)) + [(500, "lonely " + words_text(rng, 30)), (500, "lonely " + words_text(rng, 30))]
    got = op1_minhash.near_duplicates(frame(spark, rows).withColumnRenamed("source", "component_id")).collect()
    want = components_by_force(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert next(r for r in got if r["doc_id"] == len(texts) - 7)["n_shingles"] == 0


def test_templated_documents_are_passed_over(spark):
    """3,000 documents that share a template, of similarity 0.5: every one is its own class, and hardly any pair is looked at."""
    rng = random.Random(17)
    template = words_text(rng, 104, 10**6)
    texts = [template + " " + words_text(rng, 46, 10**6) for _ in range(3000)]
    texts += [edited(rng, texts[7], 1), edited(rng, texts[9], 2)]
    docs = frame(spark, enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in op1_minhash.near_duplicates(docs).collect()}
    assert got == {i: {3000: 7, 3001: 9}.get(i, i) for i in range(3002)}
    sets = docs.selectExpr("doc_id as node", "text").mapInArrow(op1_minhash._shingle_sets(5), "node long, shingles array<long>")
    nodes = docs.selectExpr("doc_id as node", "0L as s1", "0L as s2", "doc_id as component")
    pairs = {(r["a"], r["b"]) for r in op1_minhash.across(nodes, sets, 75).collect()}
    assert {(7, 3000), (9, 3001)} <= pairs and len(pairs) < 20


def test_pairs_across_components_by_force(spark):
    rng = random.Random(18)
    texts = [" ".join(rng.choice(["a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x", "y z 1 2 3 4"]) for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    docs = frame(spark, enumerate(texts))
    sets = docs.selectExpr("doc_id as node", "text").mapInArrow(op1_minhash._shingle_sets(5), "node long, shingles array<long>")
    nodes = docs.selectExpr("doc_id as node", "0L as s1", "0L as s2", "doc_id % 40 as component")
    pairs = {(r["a"], r["b"]) for r in op1_minhash.across(nodes, sets, 75).collect()}
    full = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if a % 40 != b % 40 and 100 * len(full[a] & full[b]) >= 75 * len(full[a] | full[b])}
    assert want and want <= pairs


def test_near_duplicates_edges(spark):
    empty = frame(spark, [])
    assert op1_minhash.near_duplicates(empty).count() == 0
    got = op1_minhash.near_duplicates(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None)])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("2", "2", True), ("3", "3", True), ("3", "3", True), ("None", "None", None)]
    kept = op1_minhash.one_of_each(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None"] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# ---- 2. licences


def test_licence_scan_finds_notices_by_exact_containment(spark):
    rng = random.Random(5)
    gpl, mit = op2_licenses.TEMPLATES["gpl-3.0"], op2_licenses.TEMPLATES["mit"]
    texts = [(1, words_text(rng, 500) + " " + gpl.upper() + " " + words_text(rng, 50)), (2, mit), (3, "released under the mit licence"), (4, None), (5, ""), (6, "license " * 40), (7, words_text(rng, 3000) + " " + mit), (8, gpl.replace("General", "Lesser")), (2, mit)]
    got = {(r["doc_id"], r["license"]): r["containment"] for r in op2_licenses.scan(frame(spark, texts).withColumnRenamed("lang", "license")).collect()}
    assert got == {(1, "gpl-3.0"): 1.0, (2, "mit"): 1.0, (7, "mit"): 1.0}
    assert op2_licenses.scan(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op2_licenses.scan(frame(spark, []), {"short": "too short"})


def test_every_shingle_of_a_template_holds_an_anchor():
    for text in op2_licenses.TEMPLATES.values():
        shingles = op2_licenses._shingle_list(op2_licenses.words_of(text))
        chosen = op2_licenses._anchors(shingles)
        assert shingles and all(chosen & set(s.split()) for s in shingles)


def test_every_template_meets_its_windows():
    for text in op2_licenses.TEMPLATES.values():
        w = op2_licenses.words_of(text)
        j = op2_licenses.least_jaccard(w)
        assert (1 - j) ** op2_licenses.bands_for(j) <= op2_licenses.MISS
    assert op2_licenses.least_jaccard(op2_licenses.words_of(op2_licenses.TEMPLATES["mit"])) == 1 / 12


def test_shortest_template_in_one_full_window_is_never_missed(spark):
    rng = random.Random(22)
    texts = [(i, words_text(rng, 12 + i % 4, 10**6) + " " + op2_licenses.TEMPLATES["mit"] + " " + words_text(rng, 40, 10**6)) for i in range(4000)]
    got = op2_licenses.scan(frame(spark, texts)).collect()
    assert len(got) == 4000 and {(r["license"], r["containment"], r["word"]) for r in got} == {("mit", 1.0, 8)}


# ---- 5. SentencePiece

ODD = ["", "  a  b ", "<s>x</s> <0x0A>", "é漢字😀 it's 123٣\n\n y\t", " " * 37 + "x", "a" * 3000, "\r\n{\r", None, "the the The", "\x00 \x85"]


def test_sentencepiece_is_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path(op5_sentencepiece.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice("aeinrst▁hé-. \n") for _ in range(rng.randrange(200))) for _ in range(150)]
    docs = frame(spark, enumerate(texts)).withColumnRenamed("source", "ids")
    coded = op5_sentencepiece.encode(docs, path, "doc_id")
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in op5_sentencepiece.decode(coded, path, "doc_id").collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    trips = op5_sentencepiece.round_trips(docs, path, "doc_id").collect()
    assert all(r["round_trip"] == ("▁" not in (texts[r["doc_id"]] or "")) for r in trips)
    assert op5_sentencepiece.round_trips(frame(spark, []), path, "doc_id").count() == 0


def test_unigram_words_have_the_best_sum_of_scores():
    rng = random.Random(1)
    pieces = [("<unk>", 0.0, 2), *((p, -rng.random() * 5, 1) for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "▁", "▁a"])]
    coder = op5_sentencepiece.PieceCoder({"type": op5_sentencepiece.UNIGRAM, "prefix": True, "pieces": pieces})
    score = {p: s for p, s, kind in pieces if kind == 1}

    def best(word):
        if not word:
            return 0.0
        return max(score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in score)

    some = sorted({"▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    for word, ids in coder.walk(some):
        assert "".join(pieces[i][0] for i in ids) == word
        assert abs(sum(score[pieces[i][0]] for i in ids) - best(word)) < 1e-9


# ---- 6. languages


@pytest.mark.parametrize("langs", [2, 3, 4])
def test_languages_switch_where_a_word_by_word_viterbi_does(monkeypatch, langs):
    rng, n, switch = np.random.default_rng(6), 9, op6_language.SWITCH
    for _ in range(60):
        logs = (rng.integers(-40, 1, (langs, n)) * switch / 16).astype(np.float32)
        monkeypatch.setattr(op6_language, "_features", lambda p: (np.arange(n), np.arange(n), np.zeros(n, int)))
        piece = next(words.pieces(pa.array([" ".join("abcdefghi")]), words.ALNUM, True))
        scores, count, _, steps = op6_language._steps(piece, {"logs": logs, "writes": np.ones((langs, 1), bool)})
        path = np.repeat(op6_language._viterbi(scores, steps), count)
        value = logs[path, np.arange(n)].sum() - switch * (path[1:] != path[:-1]).sum()
        v = logs[:, 0].astype(float)
        for t in range(1, n):
            v = np.maximum(v, v.max() - switch) + logs[:, t]
        assert abs(value - v.max()) < 1e-3


def test_languages_of_spans_and_scripts(spark):
    en = "the house is green and the garden is wide with many old trees near the river"
    de = "das haus ist grün und der garten ist weit mit vielen alten bäumen nahe dem fluss"
    ru = "дом зелёный и сад широкий со многими старыми деревьями возле реки"
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 5)] + [(90, None, "en", "s", 0), (91, "x", None, "s", 0)]
    model = op6_language.learn(spark.createDataFrame(rows, SCHEMA))
    assert model["langs"] == ["de", "en", "ru"]
    docs = frame(spark, [(1, en), (2, de), (3, ru), (4, None), (5, "12 34 !!"), (6, ""), (7, f"{en} {de} {de}"), (8, "Ж"), (9, en + " ! " * 3000)]).withColumnRenamed("source", "score")
    got = {r["doc_id"]: r for r in op6_language.languages(docs, model, "doc_id").collect()}
    assert [got[i]["lang_pred"] for i in range(1, 10)] == ["en", "de", "ru", "und", "und", "und", "de", "ru", "en"]
    assert got[4]["score"] == 0 and got[1]["score"] == 1 and 0.5 < got[7]["score"] < 0.8
    assert [s["lang"] for s in got[7]["spans"]] == ["en", "de"] and abs(got[7]["spans"][1]["lo"] - len(en.split())) <= 1
    kept = op6_language.keep_known(docs, model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7, 8, 9] and kept.columns == docs.columns
    nothing = op6_language.learn(frame(spark, []))
    assert [r["lang_pred"] for r in op6_language.languages(frame(spark, [(1, "a")]), nothing, "doc_id").collect()] == ["und"]
    assert op6_language.languages(frame(spark, []), model, "doc_id").count() == 0


def test_viterbi_is_the_best_path():
    import numpy as np

    rng = np.random.default_rng(4)
    counts = np.array([5, 0, 1, 6, 3])
    scores = (rng.normal(size=(counts.sum(), 3)) * 8).astype(np.float32)
    got, at = op6_language._viterbi(scores, counts), 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda path: sum(own[i, p] for i, p in enumerate(path)) - op6_language.SWITCH * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert not n or abs(max(map(value, itertools.product(range(3), repeat=int(n)))) - value(list(got[at : at + n]))) < 1e-3
        at += n


# ---- 7. token counts


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(op7_token_counts.VOCABULARY)
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [*ODD, "<|endoftext|>x<|endoftext|> <|endoftext", "<|endoftext|>" * 3, "it's I'LL we've  done", *("".join(rng.choice("aeinrstoé' \n12<|>.") for _ in range(rng.randrange(120))) for _ in range(100))]
    docs = frame(spark, enumerate(texts)).withColumnRenamed("source", "n_tokens")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in op7_token_counts.token_counts(docs, path, "doc_id").collect()}
    assert got == {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    assert op7_token_counts.token_counts(frame(spark, []), path, "doc_id").count() == 0


# ---- 8. decontamination


def hits_by_force(text, items, width=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, ids = find(text), set(), set()
    for i, t in items:
        v = find(t)
        size = min(width, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == v[k : k + size]:
                    hit |= set(range(at, at + size))
                    ids.add(i)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("held", [op8_decontaminate.HELD, 0])
def test_benchmark_hits_by_force(spark, held):
    rng = random.Random(8)
    items = [(1, words_text(rng, 30)), (2, "Short Item, here"), (3, None), (4, "..."), (5, words_text(rng, 13)), (5, words_text(rng, 13)), (None, "null id here")]
    texts = ["", None, items[0][1].upper(), "x " + items[0][1][10:90] + " y", "a short item here. Short-item here", words_text(rng, 50), items[4][1] + " " + items[0][1], "zz " * 400 + items[4][1], "null id here", "long " * 120_000 + items[0][1]]
    docs = frame(spark, enumerate(texts)).withColumnRenamed("source", "hit").withColumnRenamed("lang", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in op8_decontaminate._n_hit(op8_decontaminate.benchmark_hits(docs, bench, "doc_id", held=held)).collect()}
    want = {i: hits_by_force(t, [x for x in items if x[0] is not None]) for i, t in enumerate(texts)}
    assert got == want
    clean = op8_decontaminate.drop_contaminated(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)} and clean.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in op8_decontaminate.remove_spans(docs, bench, "doc_id").collect()}
    assert cut[5] == texts[5] and cut[1] is None and hits_by_force(cut[3], items[:1])[1] == 0
    assert op8_decontaminate.benchmark_hits(docs, bench.limit(0), "doc_id").filter("size(hit) > 0").count() == 0
    twice = op8_decontaminate.benchmark_hits(docs.union(docs).withColumn("doc_id", F.lit(None)), bench, "doc_id", "n_chars")
    assert twice.count() == 2 * len(texts) and twice.filter("size(hit) > 0").count() == 2 * sum(h > 0 for _, h, _ in want.values())


def test_a_large_benchmark_is_a_bloom_filter():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2))
    k = 21
    bits = np.zeros(1 << k, bool)
    for probe in range(op8_decontaminate.PROBES):
        bits[op8_decontaminate._probe(keys, probe, k).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little").reshape(-1, op8_decontaminate.BLOCK_BYTES)
    known = op8_decontaminate.KeySet([13], None, {i: x.tobytes() for i, x in enumerate(packed)}, k)
    assert len(known.has(keys)) == len(keys) and len(known.has(keys + np.uint64(1))) < 20


# ---- 9. repeated passages


def repeats_by_force(texts, width):
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for d, w in enumerate(split):
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), []).append((d, k))
    gone = [set() for _ in texts]
    for spots in seen.values():
        if len(spots) > 1:
            for d, k in spots:
                gone[d] |= set(range(k, k + width))
    return [(len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for w, g in zip(split, gone, strict=True)]


def test_repeated_passages_by_force(spark, tmp_path):
    rng = random.Random(12)
    passage = words_text(rng, 60)
    texts = [words_text(rng, 20) + "\n" + passage + " " + words_text(rng, 20), passage, words_text(rng, 30) + "  " + " ".join(passage.split()[5:45]), "of " * 90, "x y " * 40, None, "", words_text(rng, 34), words_text(rng, 35)]
    texts += [texts[0]] * 2 + [edited(rng, passage, 1) for _ in range(6)] + [words_text(rng, 400) for _ in range(3)] + [texts[8]]
    docs = frame(spark, enumerate(texts))
    want = repeats_by_force(texts, 35)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op9_substrings.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (n, gone, rest) in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(rest.encode()).hexdigest()), i
    left = op9_substrings.remove_repeats(docs.withColumnRenamed("source", "_spans").withColumnRenamed("lang", "row"))
    assert {r["doc_id"]: " ".join((r["text"] or "").split()) for r in left.collect()} == {i: rest for i, (_, _, rest) in enumerate(want)}
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect() if r["text"] is not None)
    assert left.filter("doc_id = 5").first()["text"] is None


def test_repeated_passages_edges(spark, tmp_path):
    rng = random.Random(13)
    p = words_text(rng, 40)
    frame(spark, [(None, p + " tail"), (7, "head " + p), (7, words_text(rng, 50)), (8, "a b"), (None, "c")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in op9_substrings.query(spark, str(tmp_path)).collect())
    assert got == [("7", 41, 40), ("7", 50, 0), ("8", 2, 0), ("None", 1, 0), ("None", 41, 40)]
    frame(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op9_substrings.query(spark, f"{tmp_path}/none").count() == 0


def paths_by_force(edges):
    """Repeated edges (u, v) -> the sets of edges that hang together over nodes with one edge in and one out."""
    ins, outs = {}, {}
    for e in edges:
        outs.setdefault(e[0], []).append(e)
        ins.setdefault(e[1], []).append(e)
    group = {e: {e} for e in edges}
    for node in set(ins) & set(outs):
        if len(ins[node]) == len(outs[node]) == 1:
            a, b = group[ins[node][0]], group[outs[node][0]]
            if a is not b:
                a |= b
                for e in b:
                    group[e] = a
    return {frozenset(g) for g in group.values()}


def test_paths_are_compacted_over_unbranched_nodes(spark):
    rng = random.Random(14)
    for case in range(3):
        edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(16)} if case else {(1, 2), (2, 3), (2, 4), (5, 2), (7, 8), (8, 7), (9, 9)}
        # sources: some stretches follow each other in the text, others lie apart
        at, place = {}, 0
        for e in sorted(edges):
            place += rng.choice([1, 1, 5])
            at[e] = place
        for e in sorted(edges):  # a successor right behind its edge
            after = [f for f in sorted(edges) if f[0] == e[1] and f != e]
            if after and rng.random() < 0.7 and at[e] + 1 not in at.values():
                at[after[0]] = at[e] + 1
        rows = spark.createDataFrame([(u, v, s) for (u, v), s in at.items()], "u long, v long, src long")
        got = {}
        for r in op9_substrings.compact(rows).collect():
            for s in range(r["start"], r["end"]):
                got.setdefault(r["path"], set()).add(next(e for e, x in at.items() if x == s))
        assert {frozenset(x) for x in got.values()} == paths_by_force(edges) and sum(map(len, got.values())) == len(edges)


@pytest.mark.parametrize("bits", [2, 7])
def test_words_decide_where_hashes_collide(spark, bits):
    rng = random.Random(15)
    short, long_ = words_text(rng, 30, 10**6), words_text(rng, 45, 10**6)
    texts = [words_text(rng, 15) + " " + short + " " + words_text(rng, 15) for _ in range(8)]  # anchors repeat, no window does
    texts += [words_text(rng, 9) + " " + long_, long_ + " " + words_text(rng, 9), texts[0], "x y " * 40]
    want = repeats_by_force(texts, 35)
    every, spans, _ = op9_substrings.repeated_spans(frame(spark, enumerate(texts)), 35, bits)
    removed = {r["doc_id"]: sum(r["runs"][1::2]) - sum(r["runs"][::2]) for r in spans.collect()}
    whole = {r["doc_id"] for r in every.filter("copies > 1").collect()}
    assert whole == {0, 10}
    assert [len(texts[i].split()) if i in whole else removed.get(i, 0) for i in range(len(texts))] == [n for _, n, _ in want]


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(16)
    passage = words_text(rng, 50, 10**6)
    long_ = " ".join(map(str, range((1 << 20) - 20))) + " " + passage + " tail"  # the passage lies over the end of a slot
    docs = frame(spark, [(1, long_), (2, "a b " + passage), (3, "c " + passage[:60])])
    _, spans, _ = op9_substrings.repeated_spans(docs)
    assert {r["doc_id"]: r["runs"] for r in spans.collect()} == {1: [(1 << 20) - 20, (1 << 20) + 30], 2: [2, 52]}


def test_keys_are_dealt_and_copied(spark):
    left = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(3)], "k int, i int")
    hot = common.hot_keys(left, "k", 10)
    assert [tuple(r) for r in hot.collect()] == [(1, 10)]
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, x string")
    got = common.dealt(left, "k", hot, "i").join(common.copied(right, "k", hot), ["k", "salt"])
    assert sorted((r["k"], r["i"], r["x"]) for r in got.collect()) == [(1, i, "a") for i in range(100)] + [(2, i, "b") for i in range(3)]
    assert got.filter("k = 1").select("salt").distinct().count() > 5


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_language_labels_of_very_long_texts():
    rng, langs, switch = np.random.default_rng(8), 4, op6_language.SWITCH
    counts = np.array([200_000, 3, 1, 40_000])
    total = int(counts.sum())
    scores = rng.normal(-54, 2, (total, langs)).astype(np.float32)
    scores[np.arange(total), np.arange(total) // 40 % langs] += 3  # the true language changes every forty words
    got, at = op6_language._viterbi(scores, counts), 0
    for n in counts:
        s = scores[at : at + n].astype(float)
        v, back = s[0].copy(), np.zeros((n, langs), int)
        for t in range(1, n):
            top = v.argmax()
            stays = v >= v[top] - switch
            back[t] = np.where(stays, np.arange(langs), top)
            v = np.where(stays, v, v[top] - switch) + s[t]
        path = np.zeros(n, int)
        path[-1] = v.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t][path[t]]
        assert (got[at : at + n] == path).all()
        at += n


def test_language_of_a_long_text_of_two(spark):
    en, de = "the house is green and the garden is wide", "das haus ist grün und der garten ist weit"
    model = op6_language.learn(spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), ("la casa es verde y el jardín", "es")] * 5)], SCHEMA))
    long = " ".join([" ".join([en] * 3000), " ".join([de] * 3001), " ".join([en] * 3000)])
    rows = op6_language.languages(frame(spark, [(1, long), (1, long), (None, long)]), model, "doc_id").collect()
    assert [r["lang_pred"] for r in rows] == ["en"] * 3 and all([s["lang"] for s in r["spans"]] == ["en", "de", "en"] for r in rows)


def test_substrings_of_a_text_over_several_slots(spark, tmp_path):
    long = " ".join(f"w{i % 50_021}" for i in range(5 << op9_substrings.SLOT_BITS))
    texts = [long, "x " + long[: len(long) // 2], "short " * 20, None, "short " * 20]
    frame(spark, enumerate(texts)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in op9_substrings.query(spark, str(tmp_path)).collect()}
    assert got == {i: n for i, (_, n, _) in enumerate(repeats_by_force(texts, 35))}
