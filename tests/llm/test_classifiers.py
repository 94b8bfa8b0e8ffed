"""Held-out accuracy of the learned operators, their edge cases, and the secret scan against plain patterns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelwise.llm import toxicity as tox
from reelwise.llm.language import languages
from reelwise.llm.nbsvm import quality_scores
from reelwise.llm.secret_scan import battery, encoding_of, secrets
from reelwise.llm.toxicity import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def crc(doc, n):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % n


def balanced(rows, truth, names):
    rates = [np.mean([p == c for d, p in rows if truth.get(d) == c]) for c in names]
    return float(np.mean(rates))


def test_quality(docs, labels):
    rows = quality_scores(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (crc(r.doc_id, 5) == 0) for r in rows)
    assert balanced([(r.doc_id, r.predicted) for r in rows if r.held_out], truth, (0, 1)) > 0.9


def test_toxicity(docs, labels):
    rows = toxicity(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == 1000 and all(r.held_out == (crc(r.doc_id, 4) == 2) for r in rows)
    assert balanced([(r.doc_id, r.predicted) for r in rows if r.held_out], truth, (0, 1)) > 0.75
    known = {r.doc_id for r in labels.collect() if crc(r.doc_id, 4) != 2}
    assert all(e.doc_id in known and e.toxic == truth[e.doc_id] for r in rows for e in r.evidence)


def test_toxicity_of_rare_words(spark):
    """Words of one example only still lead to it."""
    own = [i for i in range(200) if crc(i, 4) != 2][:60]
    asked = [i for i in range(1000, 1200) if crc(i, 4) == 2][:20]
    texts = {i: " ".join(f"{k}v{i}word" for k in range(12)) for i in own}
    rows = [*texts.items(), *((q, texts[i] + " more") for q, i in zip(asked, own))]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in own], "doc_id long, toxic int")
    done = {r.doc_id: r.evidence for r in toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(done[q][0].doc_id == i and done[q][0].similarity > 0.95 for q, i in zip(asked, own))


def test_language(docs):
    rows = languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [(r.doc_id, r.lang_pred) for r in rows if r.held_out]
    assert len(rows) == 1000 and balanced(held, truth, ("en", "de", "fr", "es")) > 0.95


EDGE = [(None, None), (1, ""), (1, "12 !!"), (2, "\t\n"), (2, "word"), (3, "é" * 200_000)]


def test_edges(spark, docs, labels):
    frame = spark.createDataFrame(EDGE, "doc_id long, text string")
    for made in (quality_scores(frame, labels), toxicity(frame, labels), quality_scores(frame, labels.limit(0)), toxicity(frame, labels.limit(0))):
        rows = made.collect()
        assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    with_lang = docs.select("doc_id", "text", "lang").unionByName(frame.selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang"))
    rows = [r for r in languages(with_lang).collect() if r.doc_id is None or r.text in [t for _, t in EDGE]]
    assert {r.lang_pred for r in rows if not r.text or not re.search(r"\w*[^\W\d]", r.text)} == {"und"}
    assert {r.lang_pred for r in languages(frame.selectExpr("*", "'x' lang").limit(0)).collect()} == set()
    assert {r.lang_pred for r in languages(frame.selectExpr("*", "CAST(NULL AS STRING) lang")).collect()} == {"und"}
    for made in (quality_scores(frame.limit(0), labels), toxicity(frame.limit(0), labels), secrets(frame.limit(0))):
        assert made.count() == 0
    assert [r.spans for r in secrets(frame).collect()] == [[]] * len(EDGE)


def test_nearest_is_exact():
    draw = np.random.default_rng(2)
    n = 900
    words = [draw.zipf(1.4, 6) % 60 for _ in range(n)]
    pairs = [(i, t, int((x == t).sum())) for i, x in enumerate(words) for t in sorted(set(x.tolist()))]
    rows, where, counts = (np.array(x, np.int64) for x in zip(*pairs))
    terms = (np.arange(60, dtype=np.uint64) + np.uint64(1)) * np.uint64(1 << 40)
    index = tox.build(np.arange(n), (draw.random(n) < 0.3).astype(np.int64), terms, rows, where, counts)
    dense = np.zeros((n, len(index.terms)))
    term = np.repeat(np.arange(len(index.terms)), np.diff(index.starts))
    dense[index.examples, term] = index.weights
    for i in range(0, n, 7):
        _, t, w = index.vectors(np.zeros(6, np.int64), terms[words[i]])
        best, likeness = index.nearest(t, w, 15)
        wanted = dense[:, t] @ w
        order = np.lexsort((np.arange(n), -np.round(wanted, 9)))[:15]
        order = order[wanted[order] > 0]
        assert best.tolist() == order.tolist() and np.allclose(likeness, wanted[order])


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(out)]


def test_secret_patterns(spark, docs):
    texts = [
        'é API_KEY = "abcdefghijkl" and token: short, Secret="x" passwd:\'0123456789abcdef\'',
        "AKIAAKIA" + "A1" * 8 + " AKIA123 deadbeefdeadbeef0 ſecret=abcdefghijklmn token=secret=abcdefghijkl",
        "0123456789abcde 0123456789ABCDEF0 password==== " + "f" * 40,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    for r in secrets(frame).collect():
        assert [(x.start, x.kind, x.end) for x in r.base] == plain_base(r.text), r.text[:200]
        assert set(r.base) <= set(r.spans)
        places = [(x.start, ("assign", "access", "hex", "random").index(x.kind)) for x in r.spans]
        assert places == sorted(places)


def test_random_tokens(spark):
    draw = np.random.default_rng(8)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    keys = ["".join(draw.choice(letters, 44)) for _ in range(200)]
    assert np.mean([min(battery(k, encoding_of(k))) >= 0.01 for k in keys]) > 0.9
    words = ["".join(draw.choice(["tion", "er", "the", "an", "ing", "re"], 12)) for _ in range(400)]
    frame = spark.createDataFrame([(i, f"see {k} or {w} here") for i, (k, w) in enumerate(zip(keys, words))], "doc_id long, text string")
    spans = [[(x.start, x.end) for x in r.spans if x.kind == "random"] for r in secrets(frame).orderBy("doc_id").collect()]
    assert np.mean([s == [(4, 48)] for s in spans]) > 0.75
    assert not any(a > 48 for s in spans for a, _ in s)


def test_blocks_that_cannot_hold_a_neighbour_are_skipped():
    draw = np.random.default_rng(4)
    n, group = 4 * tox.BLOCK, np.repeat(np.arange(4), tox.BLOCK)
    # four groups of examples with words of their own
    parts = [np.unique(g * 10 + draw.integers(0, 10, 6)) for g in group]
    rows, where = np.repeat(np.arange(n), [len(x) for x in parts]), np.concatenate(parts)
    terms = (np.arange(40, dtype=np.uint64) + np.uint64(1)) * np.uint64(1 << 40)
    index = tox.build(np.arange(n), group % 2, terms, rows, where, np.ones(len(rows), np.int64))
    weights = np.zeros((n, 40))
    weights[index.examples, np.repeat(np.arange(40), np.diff(index.starts))] = index.weights
    row, term, weight = index.vectors(np.zeros(10, np.int64), terms[:10])
    index.prepare()
    rough = index._rough(row, term, weight, 1, 5).reshape(-1, tox.BLOCK)
    assert (rough[:, 0] == -1).sum() >= 2
    best, likeness = index.nearest(term, weight, 5)
    wanted = weights[:, term] @ weight
    assert best.tolist() == np.lexsort((np.arange(n), -np.round(wanted, 9)))[:5].tolist() and np.allclose(likeness, wanted[best])


def test_whole_scores_match_brute_force(spark):
    """Terms, cosines, votes, leave-one-out calibration and scores from their definitions."""
    import random

    from reelwise.llm.linear import fit_sigmoid, sigmoid

    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocab[: 40 if i % 3 else 80]) for _ in range(rng.randint(0, 30))) for i in range(90)] + ["", None, "zzzz"]
    marked = {i: int(i % 3 == 0) for i in range(70)}
    known = sorted(i for i in marked if zlib.crc32(str(i).encode()) % 4 != 2)
    stems = [Counter(w.encode()[: tox.STEM] for w in (t or "").split()) for t in texts]
    df = Counter(s for i in known for s in stems[i])

    def vector(counts):
        v = {s: (1 + math.log(c)) * math.log(1 + len(known) / df[s]) for s, c in counts.items() if s in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {s: x / norm for s, x in v.items()}

    examples = {i: vector(stems[i]) for i in known}
    bare = [marked[i] for i in known if not examples[i]]
    unmarked = (sum(bare) + 0.5) / (len(bare) + 5.0)

    def vote(own, leave):
        likeness = {i: sum(x * examples[i].get(s, 0) for s, x in own.items()) for i in known if i != leave}
        best = sorted((i for i in likeness if likeness[i] > 0), key=lambda i: (-round(likeness[i], 9), i))[: tox.NEIGHBOURS]
        total = sum(likeness[i] for i in best)
        return (sum(likeness[i] * marked[i] for i in best) + tox.PRIOR * unmarked) / (total + tox.PRIOR) if own else unmarked

    a, b = fit_sigmoid(tox.logit(np.array([vote(examples[i], i) for i in known])), np.array([marked[i] for i in known]))
    wanted = [float(sigmoid(a * tox.logit(np.array([vote(vector(s), None)])) + b)[0]) for s in stems]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(marked.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity(frame, labels).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], wanted, atol=1e-9)


def test_clashing_names_and_repeated_rows(spark, docs, labels):
    """Columns that carry the operators' own names, and rows given twice: every row stays and scores alike."""
    some = docs.limit(60).selectExpr("doc_id", "text", "lang", "1 AS row", "'x' AS score", "2 AS held_out", "3 AS c0", "4 AS spans", "5 AS label", "6 AS example")
    frame = some.unionByName(some)
    plain = some.select("doc_id", "text", "lang")
    for made, bare, name in (
        (quality_scores(frame, labels), quality_scores(plain.unionByName(plain), labels), "score"),
        (toxicity(frame, labels), toxicity(plain.unionByName(plain), labels), "score"),
        (languages(frame), languages(plain.unionByName(plain)), "lang_pred"),
        (secrets(frame), secrets(plain.unionByName(plain)), "spans"),
    ):
        rows = made.collect()
        want = {r.doc_id: r[name] for r in bare.collect()}
        assert len(rows) == 2 * len(want) and all(r.c0 == 3 and r.label == 5 and r.row == 1 for r in rows)
        assert all(r[name] == pytest.approx(want[r.doc_id]) if name == "score" else r[name] == want[r.doc_id] for r in rows)


def test_rare_language_is_learned(spark, docs):
    """Thirty texts in a language of their own beside a common one; the whole sample is smaller than the common one."""
    common = [(i, "the quick brown fox and the lazy dog " * 3, "en") for i in range(1500)]
    rare = [(5000 + i, "zlkq vrtz pplm xxrt qqvz " * 4 + str(i), "xx") for i in range(30)]
    rows = {r.doc_id: r.lang_pred for r in languages(spark.createDataFrame(common + rare, "doc_id long, text string, lang string"), max_labelled=100).collect()}
    assert {rows[i] for i, _, _ in rare} == {"xx"} and {rows[i] for i, _, _ in common} == {"en"}


def test_many_short_texts_stay_small():
    import tracemalloc

    import pyarrow as pa

    from reelwise.llm.batches import slices
    from reelwise.llm.language import SLICE_ROWS, features

    batch = pa.RecordBatch.from_arrays([pa.array([f"some short text {i % 9}" for i in range(10_000)])], names=["text"])
    tracemalloc.start()
    for rows, data, offsets in slices(batch, "text", 1 << 18, SLICE_ROWS):
        assert len(features(data, offsets)) == rows.num_rows <= SLICE_ROWS
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
