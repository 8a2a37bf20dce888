"""Clustering, spelling variants and languages against plain Python, on odd tables and with small constants."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tidewatch.llm import common, jaccard, language, lloyd, spelling, windows

MEDIUM = "/root/testdata/sf0.01"


# Clustering


def plain_lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((brute.sha(f"3:{'' if i is None else i}"), v) for i, v in kept)
    centroids = [list(v) for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return Counter((i, c, d, sums[c], sum(sums.values()), brute.sha(",".join(map(str, centroids[c])))) for i, c, d in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", [1], 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string, v array<int>, label int")


def rows_of(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, brute.sha(",".join(map(str, r.centroid)))) for r in df.collect())


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    spread = rng.normal(size=(60, 64)).astype(np.float32)
    same = spread[0].tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(spread)] + [(7, same)] * 40 + [(None, same), (None, spread[3].tolist()), (70, None), (71, [0.5] * 63), (72, [0.5] * 65), (73, [None] + same[1:]), (74, [float("nan")] + same[1:]), (75, [float("inf")] + same[1:]), (76, []), (77, [-0.0] * 64), (78, [-1e-30] * 64)]
    assert rows_of(lloyd.clusters(vectors(spark, rows).repartition(5))) == plain_lloyd(rows, 8, 10, 64)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors_make_as_many_clusters(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert rows_of(lloyd.clusters(vectors(spark, rows))) == plain_lloyd(rows, 8, 10, 64)


def test_centroids_without_vectors_stay(spark):
    rows = [(i, [1.0] * 64) for i in range(20)] + [(30, [2.0] * 64)]
    assert rows_of(lloyd.clusters(vectors(spark, rows))) == plain_lloyd(rows, 8, 10, 64)


def test_components_beyond_the_limit_are_an_error(spark):
    with pytest.raises(Exception, match="a component of"):
        lloyd.clusters(vectors(spark, [(1, [2e5] * 64)]))


# Spelling


def plain_words(texts):
    n = Counter()
    for i, text in texts:
        for run in brute.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    out, form = {}, {}
    for w in n:
        near = [o for o in n if is_near(w, o)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], out[w], form[w] and n[form[w]]) for w in n}


def found_variants(df):
    return {tuple(r) for r in df.collect()}


def test_variants_of_odd_tables(spark, odd, none):
    for docs in (odd, none):
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        assert found_variants(spelling.variants(docs)) == plain_variants(plain_words(texts))


@pytest.mark.parametrize("small", [False, True])
def test_variants_of_generated_words(spark, monkeypatch, small):
    """Chains, ties, runs of equal letters, letters beyond ASCII, long words; few keys a batch and a partition, or many."""
    if small:
        monkeypatch.setattr(spelling, "LETTERS", 20)
        monkeypatch.setattr(spelling, "KEYS", 50)
    words = {"aaaaaa": 700, "aaaaaaa": 130, "aaaaaaaa": 20, "abaaaa": 20, "letters": 60, "lettres": 9, "leters": 11, "letter": 12, "lettera": 12, "létters": 5, "größeres": 30, "grösseres": 5, "größere": 6, "x" * 300: 40, "x" * 299 + "y": 6, "y" + "x" * 299: 5, "z" * 301: 7, "ÀÉÎÕÜý": 25, "ÀÉÎÕÜÿ": 5, "ab×cd÷": 5, "ab×cd": 9}
    texts = [(i, " ".join(w for w, n in words.items() if i < n)) for i in range(700)]
    docs = spark.createDataFrame([(i, t, 1, "s", "w") for i, t in texts], "doc_id long, text string, n int, word string, form string").repartition(4)
    assert found_variants(spelling.variants(docs)) == plain_variants(plain_words(texts))


def test_hashes_that_agree_join_no_words(spark, monkeypatch):
    """All keys collide; the strings decide."""
    monkeypatch.setattr(spelling.common, "mix", lambda h: h * np.uint64(0))
    texts = [(i, "garden gardan gardens hollow hollaw meadow " + "harbour " * 6) for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert found_variants(spelling.variants(docs)) == plain_variants(plain_words(texts))


@settings(max_examples=200, deadline=None)
@given(st.text("abé", min_size=1, max_size=9), st.text("abé", min_size=1, max_size=9))
def test_near_words_share_one_key_and_others_none(a, b):
    keys, word, slot = spelling.keys_of([a, b])
    kind = lambda s: np.where(s == spelling.OWN, 0, 1 + s % 2)  # noqa: E731  own, opened, gone
    one = Counter((int(k), int(t)) for k, w, t in zip(keys, word, kind(slot), strict=True) if w == 0)
    two = Counter((int(k), int(t)) for k, w, t in zip(keys, word, kind(slot), strict=True) if w == 1)
    pairs = sum(one[k, t] * two[k, u] for k, t in one for u in (0, 1, 2) if (t, u) in {(1, 1), (0, 2), (2, 0)})
    assert a == b or pairs == is_near(a, b)


# Languages


def plain_bits(train, texts, order=4):
    """Code lengths from context trees as nested counts, by the definition: a byte, an escape, or the next shorter context."""
    seen = defaultdict(lambda: defaultdict(Counter))
    for text, lang in train:
        if text is not None and lang is not None:
            data = b"\xff" * order + text.lower().encode("utf-8", "replace")
            for i in range(order, len(data)):
                for k in range(order + 1):
                    seen[lang][data[i - k : i]][data[i]] += 1
    out = []
    for text in texts:
        data = b"\xff" * order + (text or "").lower().encode("utf-8", "replace")
        row = {}
        for lang, tree in seen.items():
            total = 0.0
            for i in range(order, len(data)):
                for k in range(order, -1, -1):
                    after = tree.get(data[i - k : i])
                    if after is None:
                        continue
                    every = sum(after.values()) + len(after)
                    if data[i] in after:
                        total -= math.log2(after[data[i]] / every)
                        break
                    total -= math.log2(len(after) / every)
                else:
                    total += 8
            row[lang] = total
        out.append(row)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_code_lengths_are_those_of_plain_trees(spark, odd, monkeypatch, small):
    if small:
        for name, n in (("FLUSH", 50), ("SEND", 200), ("BATCH", 37), ("HELD", 100)):
            monkeypatch.setattr(language, name, n)
    train = [("the river bends past the mill", "en"), ("der Fluß biegt an der Mühle ab", "de"), ("la rivière passe le moulin", "fr"), ("abababab", "en"), (None, "xx"), ("no language", None), ("", "de"), ("的河流 😀", "zh")]
    texts = [t for t, _ in train if t] + ["the mill", "die Mühle", "qqqq", "\U0001f600 zzz", "a\x00b", "x"]
    model = language.train(spark.createDataFrame(train * 3, "text string, lang string").repartition(3))
    assert model.langs == ["de", "en", "fr", "zh"]
    want = plain_bits(train * 3, texts)
    assert np.allclose(model.bits(texts), [[w[x] for x in model.langs] for w in want])
    rows = language.languages(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    said = {r.doc_id: r.text for r in odd.collect()}
    for r in rows:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in said[r.doc_id] or "")) and (r.lang_pred != "und" or r.score == 0)


def test_nothing_to_learn_from(spark, odd, none):
    assert language.train(none) is None
    assert {(r.lang_pred, r.score) for r in language.languages(odd, None).collect()} == {("und", 0.0)}
    assert language.languages(none, language.train(odd)).count() == 0


def test_languages_hold_on_held_out_rows(spark):
    said = {r.doc_id: r.lang for r in common.documents(spark, MEDIUM).collect()}
    rows = [r for r in language.op13_language_id(spark, MEDIUM).collect() if r.held_out and said[r.doc_id] is not None]
    assert len(rows) > 100 and sum(r.lang_pred == said[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (brute.fold(r.doc_id, 4) == 2) for r in rows)


def test_the_query_is_whole(spark):
    assert language.op13_language_id(spark, SMALL).count() == common.documents(spark, SMALL).count()


# Blocks


def test_documents_of_late_partitions_have_numbers_of_their_own(spark):
    """At 100 TB a scan has some 780,000 partitions."""
    body = windows.blocks(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string").coalesce(1), "test").first().body
    uids = [(part << windows.PLACES) | k for part in (0, 1, 780_000, 2**30 - 1) for k in (0, 2**windows.PLACES - 1)]
    pdf = pd.concat(jaccard._keys(iter([pd.DataFrame({"uid": uids, "body": [bytes(body)] * len(uids)})])))
    assert pdf["node"].is_unique and (pdf["node"] >= 0).all() and len(pdf) == 2 * len(uids)
    assert windows.BLOCK // 64 < 2**windows.ROWS
