"""Whole queries against plain Python, SQL or held-out labels, on the driver's tables and on odd ones."""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import common, compression, jaccard, mixing, packing, pii, quality_rules, repeats, secrets, topk, toxicity
from tidewatch.llm.queries import ORACLE_SQL, QUERIES

MEDIUM, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
texts_of = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLE_SQL[name], SMALL)


@pytest.fixture(params=["table", "odd", "none"])
def docs(request, spark):
    return common.documents(spark, SMALL) if request.param == "table" else request.getfixturevalue(request.param)


# Packing


def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), ids.tobytes()] += 1
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length > 0
        held[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, total in Counter({i: 0 for i, _, _ in want}).items():
        own = sum(n * c for (d, n, _), c in want.items() if d == i)
        assert sum(p.length for p in held[i]) == own + total
    for (i, n, ids), c in want.items():
        covered = Counter()
        for p in held[i]:
            if p.doc_tokens == n and ids[4 * p.start : 4 * (p.start + p.length)] == p.ids:
                covered[p.start, p.length] += 1
        assert sum(length for (_, length), k in covered.items() for _ in range(k)) >= n * c
    used = padded = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        used, padded = used + at, padded + 4096
    assert padded - used < 4096


def test_packing_holds_each_id_once_and_pads_one_sequence(docs):
    check_pieces(packing.pack(docs).collect(), texts_of(docs))


@given(st.text(max_size=200))
@settings(max_examples=150, deadline=None)
def test_ids_of_words_are_those_of_the_text(text):
    words = packing.word_tokens(packing.tokenizer_path())
    want = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.ids(text), words.kind).tolist() == want


def test_the_curve_visits_neighbours():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


# Personal data


def test_private_spans_hold_the_base_ones(docs):
    got = pii.scan(docs).collect()
    tag = lambda spans: brute.digest([(pii.KINDS[x.kind], x.s, x.e) for x in spans])
    want = Counter((i, brute.digest(brute.private(t))) for i, t in texts_of(docs))
    assert Counter((r.doc_id, tag(r.base)) for r in got) == want
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in got)


def test_the_private_query_digests_its_spans(spark):
    texts = dict(texts_of(common.documents(spark, SMALL)))
    for r in pii.op2_pii(spark, SMALL).collect():
        base = brute.private(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in pii.KINDS)
        assert r.base_sha256 == brute.sha(brute.digest(base))
        assert set(filter(None, brute.digest(base).split(","))) <= set(r.spans.split(","))


def test_private_spans_of_generated_texts(spark):
    parts = ["a@b", "a@b.c", "@", ".", "1.2.3.4", "999", "4111 1111 1111 1111", "+1 234 567 890", "-", " ", "x", "é", "😀", "4", "("]
    rng = np.random.default_rng(5)
    texts = {i: "".join(rng.choice(parts, rng.integers(0, 40))) for i in range(400)}
    for r in pii.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        assert [(pii.KINDS[x.kind], x.s, x.e) for x in r.base] == brute.private(texts[r.doc_id])


@pytest.mark.parametrize("unit", [jaccard.UNIT_BYTES, 60_000])
def test_every_link_between_different_texts_is_found(spark, monkeypatch, unit):
    monkeypatch.setattr(jaccard, "UNIT_BYTES", unit)
    rng = np.random.default_rng(11)
    texts = [" ".join(w if k != cut else f"new{cut}" for k, w in enumerate(base)) for base in ([f"{b}{k}" for k in range(80)] for b in "abc") for cut in rng.integers(0, 80, 20)]
    docs = spark.createDataFrame([*enumerate([*texts, *texts[:3], "alone", ""])], "doc_id long, text string")
    rows = [r.text.split() for r in docs.orderBy("doc_id").collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))} for w in rows]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])}
    least = [min(j for j in range(i + 1) if sets[j] == sets[i]) for i in range(len(sets))]
    found = jaccard.links(docs).collect()
    got = [tuple(sorted((r.class_a, r.class_b))) for r in found]
    assert len(got) == len(set(got)) and set(got) == {(*sorted((least[i], least[j])),) for i, j in want if least[i] != least[j]}
    own = Counter(x for pair in want for x in pair)
    assert {r.doc_id: r.n_links for r in jaccard.classes_and_components(docs).collect()} == {i: own[i] for i in range(len(sets))}


def test_what_wide_patterns_match_passes_their_gates(spark):
    ips = [f"192{a}168{b}1{c}20" for a in (".", "[.]", "(.)") for b in (".", "[.]", "(.)") for c in (".", "[.]", "(.)")]
    at = ["@", " @ ", "[at]", " [ at ] ", "(at)", " ( AT ) ", " at ", "  at  "]
    mails = [f"joe{a}example{d}com" for a in at for d in (".", "[dot]", "(dot)", " [dot] ", " (dot) ", " [ dot ] ", " dot ", " DOT ")]
    cards = [f"4111{s}1111{s}1111{s}{e}" for s in (" ", ".", "/", "_", "-", " -") for e in ("1", "1111111")]
    phones = [f"{a}555{s}0199" for s in " .-" for a in ("(030)", "(030) ", "(0301)-", "030.", "030 ", "0049 030-")]
    parts = ["joe", "at", "dot", "[", "(", ")", "]", "@", ".", " ", "-", "12", "4111", "555", "(.)", "[.]", " at ", " dot "]
    rng = np.random.default_rng(7)
    texts = ips + mails + cards + phones + ["".join(rng.choice(parts, rng.integers(3, 16))) for _ in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    for k, listed in zip(pii.KINDS, (mails, ips, cards, phones), strict=True):
        matched = d.where(d.text.rlike(pii.WIDE[k]))
        assert {r.text for r in matched.collect()} >= set(listed), k
        assert [r.text for r in matched.where(~d.text.rlike(pii.WIDE_NEEDS[k])).collect()] == [], k
    found = pii.candidates(d).collect()
    for k, listed in ((0, mails), (1, ips)):
        assert {texts[r.doc_id] for r in found if any(c.kind == k and c.s == 0 and c.e == len(texts[r.doc_id]) for c in r.cand)} >= set(listed)


def planted(n=400):
    """Texts with plain and failing personal data in alike surroundings, and disguised ones from id 10,000 on."""
    rng = np.random.default_rng(9)
    full = lambda d: d + next(c for c in "0123456789" if brute.luhn(d + c))
    grouped = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, 16, 4))
    rows = []
    for i in range(n):
        card = full("".join(rng.choice(list("0123456789"), 15)))
        bad = card[:15] + str((int(card[15]) + 1) % 10)
        rows.append((i, f"write to joe{i}@example.org now; server ip 10.{i % 200}.3.4 up; visa card {grouped(card, ' ')} ok; call phone +49 30 555 01{i % 90 + 10} now"))
        rows.append((n + i, f"see order {grouped(bad, ' ')} ok; part 300.{i % 200}.400.4 up; item +12 34 now; sent a{i}@b{i}.77 now"))
    card = full("411111222223333")
    rows += [(10_000, "write to jane [at] example [dot] org now"), (10_001, "server ip 10[.]1[.]2[.]3 up"), (10_002, f"visa card {grouped(card, '.')} ok"), (10_003, "call phone (030) 555-0199 now")]
    return rows


def test_disguised_spans_are_added_as_plain_trees_say(spark):
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    found = pii.labelled(common.written(pii.candidates(df), "test"))
    trees, curve, cuts = pii.fit(found)
    want = {}
    for r in found.collect():
        base = [(i, b.s, b.e) for i, k in enumerate(pii.KINDS) for b in r[f"base_{k}"]]
        more = []
        for c in r.cand or []:
            margin = sum(t.values({f: np.array([c[f]]) for f in ["kind", *pii.FEATURES]}) for t in trees)
            free = not any(k == c.kind and s < c.e and c.s < e for k, s, e in base)
            assert free == c.free
            if c.label is None and free and pii.probability(margin, curve)[0] >= cuts[c.kind]:
                more.append((c.kind, c.s, c.e))
        want[r.doc_id] = sorted(base + more)
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.scan(df).collect()}
    assert got == want
    assert [k for i in range(10_000, 10_004) for k, _, _ in got[i]] == [0, 1, 2, 3]
    assert not any(k for i in range(400, 800) for k, _, _ in got[i])


def test_many_matches_in_one_text_take_linear_time(spark):
    text = "".join(f"u{i}@ex.org 10.0.0.{i % 250} " for i in range(10_000))
    df = spark.createDataFrame([(1, text), *planted(50)], "doc_id long, text string").repartition(1)
    pii.scan(spark.createDataFrame(planted(50), "doc_id long, text string")).collect()
    began = time.perf_counter()
    r = next(r for r in pii.scan(df).collect() if r.doc_id == 1 and len(r.base) > 100)
    assert len(r.base) == 20_000 and time.perf_counter() - began < 60


# Repeated passages


def test_repeats_are_those_of_plain_search(docs):
    got = repeats.deduplicate(docs)
    texts = texts_of(docs)
    want = Counter((i, *x) for (i, _), x in zip(texts, brute.without_repeats([t for _, t in texts]), strict=True))
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == want
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in rows)


# Toxicity and quality


def figures(spark, got, label, sf_dir):
    """The share of held-out rows of either label that are told right."""
    labels = common.labels(spark, sf_dir).select("doc_id", label)
    rows = got.where("held_out").join(labels, "doc_id").where(f"{label} IS NOT NULL").collect()
    return {k: np.mean([r.predicted == k for r in rows if r[label] == k]) for k in (0, 1)}


def test_the_toxicity_model_is_whole_at_any_size(spark):
    words = np.random.default_rng(3).integers(97, 123, (400_000, 8), dtype=np.uint8)
    junk = np.column_stack([words, np.full(len(words), 32, np.uint8)]).tobytes().decode()
    rows = [(junk, 0)] * 5 + [("zqxjkv vkjxqz", 1)] * 5
    assert len(np.unique(toxicity.grams_of(junk))) > 1_500_000
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int").repartition(4), 8)
    assert model.ratios(["zqxjkv vkjxqz"])[0] > 0.3 > 0 > model.ratios([junk[:9000]])[0]


def plain_kneser_ney(rows):
    """ratio(text) of two class models of letters of words, from their definition: grams are four letters before one (None where
    the word has none), counted by documents; shorter contexts count the different letters before them."""
    def grams(text):
        for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            w = [None] * 4 + [*word, "end"]
            yield from (tuple(w[i - 4 : i + 1]) for i in range(4, len(w)))

    count = [Counter(g for t, y in rows if y == k for g in set(grams(t))) for k in (0, 1)]
    total = [sum(c.values()) for c in count]
    off = [n1 / (n1 + 2 * n2) if (n1 := sum(v == 1 for v in c.values())) + 0 * (n2 := sum(v == 2 for v in c.values())) else 0.5 for c in count]
    level = set(count[0]) | set(count[1])
    every, types = level, []
    for _ in range(4):
        shorter = Counter(g[1:] for g in level)
        types.append(shorter)
        level = set(shorter)

    def shared(g, n=0):
        g = g[1:]
        if not g:
            return 1 / 256
        own = {x: v for x, v in by[n][g[:-1]].items()}
        whole = sum(own.values())
        left = 1 - sum(max(v - toxicity.DISCOUNT, 0) for v in own.values()) / whole
        return max(own.get(g, 0) - toxicity.DISCOUNT, 0) / whole + left * shared(g, n + 1)

    by = []
    for t in types:
        d = defaultdict(dict)
        for g, v in t.items():
            d[g[:-1]][g] = v
        by.append(d)
    scaled = [{g: c.get(g, 0) * min(total) / n for g in every} for c, n in zip(count, total, strict=True)]
    after = defaultdict(list)
    for g in every:
        after[g[:-1]].append(g)

    def model(k, ctx):
        whole = sum(scaled[k][g] for g in after[ctx]) + toxicity.SHARED
        own = {g: max(scaled[k][g] - off[k], 0) / whole for g in after[ctx]}
        return own, 1 - sum(own.values())

    def ratio(text):
        out = []
        for g in grams(text):
            if g[:-1] not in after:
                out.append(0.0)
                continue
            (o0, r0), (o1, r1) = model(0, g[:-1]), model(1, g[:-1])
            out.append(math.log((o1[g] + r1 * shared(g)) / (o0[g] + r0 * shared(g))) if g in o0 else math.log(r1 / r0))
        return sum(out) / max(1, len(out))

    return ratio


@pytest.mark.parametrize("held", [256 << 20, 100])
def test_the_toxicity_model_is_plain_kneser_ney(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held)
    words = ["vile", "villain", "slur", "calm", "water", "waiter", "green", "hills", "a", "b2", "über", "evil", "vilest"]
    rng = np.random.default_rng(8)
    rows = [(" ".join(rng.choice(words, rng.integers(1, 12), p=np.roll(np.array([3] * 4 + [1] * 9) / 21, 4 * y))), y) for y in (0, 1) for _ in range(25 + 30 * y)]
    model, ratio = toxicity.train(spark.createDataFrame(rows, "text string, label int").repartition(3), 7), plain_kneser_ney(rows)
    texts = [t for t, _ in rows] + ["", "vi", "vilx water-hill", "unknown words only", "VILE, vile! Calm."]
    for t, got in zip(texts, model.ratios(texts), strict=True):
        assert math.isclose(got, ratio(t), abs_tol=1e-9), t


def test_toxicity_without_labels_of_both_classes_in_the_first_fold(spark):
    """The curve takes another fold; without any such fold nothing is told toxic and nothing is dropped."""
    texts = [(i, "vile zqxjkv slur vkjxqz" if i % 3 == 0 else "calm water and green hills") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    every = [(i, 0, int(i % 3 == 0)) for i, _ in texts]
    some = [r for r in every if brute.fold(r[0], 5) != 1 or not r[2]]
    kinds = "doc_id long, quality int, toxic int"
    scores = {r.doc_id: r.score for r in toxicity.score(docs, spark.createDataFrame(some, kinds)).collect()}
    assert min(scores[i] for i in range(0, 60, 3)) > max(scores[i] for i in range(60) if i % 3)
    one = spark.createDataFrame([r for r in every if not r[2]], kinds)
    assert {r.score for r in toxicity.score(docs, one).collect()} == {0.0}
    assert toxicity.keep(docs, one).count() == 60


def test_letters_beyond_the_basic_plane_stay_in_their_words():
    assert len(toxicity.grams_of("a\U00010400b c")) == 6 and len(toxicity.grams_of("a\U0001F600b c")) == 6
    assert len(set(toxicity.grams_of("\U00010428\U00010429").tolist())) == 3
    assert len(toxicity.grams_of("word " * 200_000)) == 1_000_000


def test_toxicity_holds_on_held_out_rows(spark):
    got = toxicity.op4_toxicity(spark, LARGE).cache()
    share = figures(spark, got, "toxic", LARGE)
    # Two fifths of the toxic labels are on texts without any toxic word, so no model finds them.
    assert share[1] >= 0.5 and share[0] >= 0.98, share
    for r in got.collect():
        assert r.held_out == (brute.fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_quality_scores_hold_on_held_out_rows(spark):
    got = compression.op6_compression_classifier(spark, MEDIUM).cache()
    share = figures(spark, got, "quality", MEDIUM)
    assert min(share.values()) >= 0.7, share
    for r in got.collect():
        assert r.held_out == (brute.fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("module", [toxicity, compression])
def test_scores_of_odd_tables(odd, none, odd_labels, module):
    got = module.score(odd, odd_labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts_of(odd))
    assert all(0 <= r.score <= 1 for r in got)
    assert module.score(none, odd_labels).count() == 0
    assert {r.score for r in module.score(odd, odd_labels.where("1 = 0")).collect()} == {0.0 if module is toxicity else 0.5}


def test_the_filter_keeps_whole_rows(odd, none, odd_labels):
    assert toxicity.keep(odd, odd_labels).schema == odd.schema
    assert toxicity.keep(none, odd_labels).count() == 0
    assert toxicity.keep(odd, odd_labels.where("1 = 0")).count() == odd.count()


def test_held_out_labels_never_matter(spark):
    docs, labels = common.documents(spark, SMALL), common.labels(spark, SMALL)
    for module, label, folds, fold in ((toxicity, "toxic", 5, 0), (compression, "quality", 4, 2)):
        from pyspark.sql import functions as F

        turned = labels.withColumn(label, F.when(common.held_out(F.col("doc_id"), folds, fold), 1 - F.col(label)).otherwise(F.col(label)))
        scores = [sorted(map(tuple, module.score(docs, x).select("doc_id", "score").collect())) for x in (labels, turned)]
        assert scores[0] == scores[1]


# Mixing


def test_mixing_of_odd_tables(odd, none):
    got = mixing.mix(odd).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(brute.words(t))) for i, t in texts_of(odd))
    assert all(r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(odd).schema == odd.schema and mixing.repeated(none).count() == 0


@pytest.mark.parametrize("sf_dir", [MEDIUM, LARGE])
def test_words_taken_come_near_the_targets(spark, sf_dir):
    taken, target = defaultdict(int), {}
    for r in mixing.op5_mixing_sources(spark, sf_dir).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert math.isclose(taken[s], target[s], rel_tol=0.03, abs_tol=5), s


def test_inclusion_chances_sum_to_the_words_of_the_sample(spark):
    words, room, sizes = defaultdict(float), {}, defaultdict(dict)
    for r in mixing.inclusion(common.documents(spark, MEDIUM)).collect():
        words[r.source] += r.p * r.size
        room[r.source] = r.room
        sizes[r.source][r.size] = r.p
        assert 0 <= r.p < 1
    for s in room:
        assert math.isclose(words[s], room[s], rel_tol=0.01, abs_tol=1), s
        chances = [p for n, p in sorted(sizes[s].items()) if n]
        assert all(a >= b for a, b in zip(chances, chances[1:], strict=False))


@pytest.mark.parametrize("fill", [mixing.FILL, 3])
def test_mixing_takes_what_a_plain_walk_in_order_takes(spark, monkeypatch, fill):
    """Ranked documents are taken while they fit, then the nearest one; few free words are reached by passes alone or not."""
    monkeypatch.setattr(mixing, "FILL", fill)
    monkeypatch.setattr(mixing, "BINS", 8)
    rng = np.random.default_rng(6)
    docs = [(i, f"s{i % 3}", " ".join(["w"] * int(rng.choice([3, 7, 40, 90, 400])))) for i in range(300)]
    df = spark.createDataFrame([(i, s, t) for i, s, t in docs], "doc_id long, source string, text string").repartition(3)
    goal = {r.source: r for r in mixing.goals(common.written(mixing.sizes(df), "test"), mixing.WEIGHTS, mixing.SHARE, mixing.MOST).collect()}
    want = {}
    for s, g in goal.items():
        own = []
        for i, _, t in (d for d in docs if d[1] == s):
            size, u = len(t.split()), (int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            own.append((u / (1 - u) * math.sqrt(size), i, size))
        free, left = g.room, []
        for rank, i, size in sorted(own):
            want[i] = int(g.copies) * size
            if size <= free:
                free, want[i] = free - size, want[i] + size
            else:
                left.append((size, rank, i))
        if left and min(left)[0] < 2 * free:
            want[min(left)[2]] += min(left)[0]
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == want


# Secrets


def test_secrets_are_those_of_plain_search(docs):
    base = [r.kind for r in secrets.RULES if r.base]
    rows = secrets.scan(docs).collect()
    tag = lambda spans: brute.digest([tuple(x) for x in spans if x.kind in base])
    assert Counter((r.doc_id, tag(r.spans)) for r in rows) == Counter((i, brute.digest(brute.secrets(t))) for i, t in texts_of(docs))
    every = Counter((i, brute.digest(secrets.brute(t))) for i, t in texts_of(docs))
    assert Counter((r.doc_id, brute.digest([tuple(x) for x in r.spans])) for r in rows) == every


def test_redaction_leaves_no_secret(docs):
    done = secrets.redact(docs)
    assert done.schema == docs.schema
    rows = done.collect()
    assert not any(brute.secrets(r.text) for r in rows)
    same = Counter(t for _, t in texts_of(docs) if not secrets.brute(t))
    assert not same - Counter(r.text for r in rows)


def test_trigram_queries_demand_what_matches_hold():
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == ("and", ("tri", "aki"), ("tri", "kia"))
    assert secrets.trigram_query(r"[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query(r"(ab|abc)d") == ("or", ("and", ("tri", "abc"), ("tri", "bcd")), ("tri", "abd"))


# Quality rules


def test_statistics_are_those_of_plain_counts(docs):
    got = quality_rules.statistics(docs).collect()
    want = Counter((i, *brute.quality(t)[:5]) for i, t in texts_of(docs))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_the_list_keeps_good_documents(spark):
    rows = quality_rules.op8_quality_rules(spark, MEDIUM).join(common.labels(spark, MEDIUM), "doc_id").where("NOT base_failed").collect()
    assert not any(r.kept and r.base_failed for r in rows)
    assert np.mean([r.kept for r in rows if r.quality == 1]) >= 0.95


def test_lists_of_odd_labels(odd, none, odd_labels):
    for d in (odd, none):
        assert quality_rules.learn(common.written(quality_rules.statistics(d), "test"), odd_labels) == []


# Top k


@pytest.mark.parametrize("small", [False, True])
def test_top_k_of_odd_vectors(spark, monkeypatch, small):
    """With small constants a common vector is dealt over several shards, and queries go in several blocks."""
    if small:
        for name, value in (("SHARD", 60), ("BLOCK", 8), ("PAGE", 8), ("PIVOTS", 6)):
            monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 700)] + [(i, [1.0] * 6) for i in range(700, 1400)]
    rows += [(1400, None), (1420, [None] * 6), (1440, [float("nan")] * 6), (1460, [float("inf")] * 6), (None, [9.0] * 6), (1480, [1.0, 2.0]), (20, [0.5] * 6), (20, [0.5] * 6), (1500, [1e7] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    sound = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(64 * float(np.float32(y))) for y in v]
            sound.append((i, x + [0] * (6 - len(x))))
    want = Counter()
    for a, (q, x) in enumerate(sound):
        if q % 20 == 0:
            scored = sorted((-sum(m * n for m, n in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(sound) if a != b)[:20]
            want.update((q, k, i, -s) for k, (s, i) in enumerate(scored, 1))
    assert Counter(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.where("1 = 0")).count() == 0


# Near copies


def check_components(docs):
    texts = texts_of(docs)
    roots = brute.components([t for _, t in texts])
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = Counter((i, len(brute.shingles(t)), least[r]) for (i, t), r in zip(texts, roots, strict=True))
    got = jaccard.classes_and_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_components_are_those_of_all_pairs(docs):
    check_components(docs)


@pytest.mark.parametrize("unit", [5_000, 100_000])
def test_clusters_above_a_unit(spark, monkeypatch, unit):
    """Chains of near copies in a cluster that is joined in parts, cells of minimum hashes dealt over several ones."""
    monkeypatch.setattr(jaccard, "UNIT_BYTES", unit)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.integers(0, 6)):
            own[rng.integers(0, 80)] = f"n{rng.integers(0, 40)}"
        rows.append((i, " ".join(own)))
    check_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_one_row_of_each_group_stays(odd, none):
    kept = jaccard.representatives(odd).collect()
    texts = texts_of(odd)
    blank = sum(not brute.words(t) for _, t in texts)
    roots = {r for r, (_, t) in zip(brute.components([t for _, t in texts]), texts, strict=True) if brute.words(t)}
    assert len(kept) == blank + len(roots)
    assert jaccard.representatives(odd).schema == odd.schema and jaccard.representatives(none).count() == 0
