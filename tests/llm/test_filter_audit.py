"""The filter audit against direct counting, and its hash table against sets."""

import re
from itertools import permutations

import numpy as np

from reelwise.llm import filter_audit as audit
from reelwise.llm.filter_audit import filter_audit, first_occurrences, run_transducer, text_counts, transitions

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    w = WORDS.findall(text or "")
    text = text or ""
    return len(w), len(set(w)), len(text), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text)


def test_counts(spark, copies, clashing):
    rows = text_counts(clashing).collect()
    texts = dict(copies)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_words, r.n_distinct, r.n_points, r.n_capitals, r.n_symbols) == counts_of(texts[r.doc_id]), r.doc_id
        assert (r.row, r.key) == ("x", r.doc_id)
    assert len({r.digest for r in rows}) == len({t or "" for t in texts.values()})
    assert text_counts(clashing.limit(0)).count() == 0


def test_long_text_in_groups(monkeypatch):
    monkeypatch.setattr(audit, "GROUP_BYTES", 64)
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(["ab", "ß" * 40, "A" * 5000, "x#y", "\U0001f600z"], size=200)), "", "tail", " \n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    (points, capitals, symbols), starts, ends = run_transducer(data, offsets, transitions())
    owner = np.searchsorted(offsets, starts, side="right") - 1
    first = first_occurrences(data, owner, starts, ends - starts)
    for i, t in enumerate(texts):
        assert (int((owner == i).sum()), int(first[owner == i].sum()), int(points[i]), int(capitals[i]), int(symbols[i])) == counts_of(t)


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(audit, "span_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    words = ["a", "b", "a", "cc", "dd", "cc", "b", "e"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, starts, ends = run_transducer(data, np.array([0, len(data)]), transitions())
    first = first_occurrences(data, np.zeros(len(starts), np.int64), starts, ends - starts)
    assert first.tolist() == [True, True, False, True, True, False, False, True]


def brute(docs, labels):
    marks = {}
    for doc, quality, toxic in labels:
        old = marks.get(doc, (None, None))
        marks[doc] = tuple(max((v for v in pair if v is not None), default=None) for pair in zip(old, (quality, toxic)))
    marks.pop(None, None)
    least = {}
    for doc, _, text in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    failing = []
    for doc, lang, text in docs:
        n, distinct, points, capitals, symbols = counts_of(text)
        fails = {k for k, bad in zip("ABCDE", (n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * points, symbols > 0, doc is not None and doc > least[text or ""])) if bad}
        quality, toxic = marks.get(doc, (None, None))
        failing.append((lang or "", fails, quality == 1, toxic == 1))
    out = {}
    for part in {x[0] for x in failing}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in failing if x[0] == part]
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[1]]
                every = [x for x in failing if x[0] == part and k in x[1]]
                left = [x for x in left if k not in x[1]]
                removed_by[k] += len(gone)
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(x[1] == {k} for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for order in map("".join, permutations("ABCDE")):
            for step, k in enumerate(order, 1):
                out[part, order, step].append(removed_by[k])
    return out


def test_audit(spark, copies):
    docs = [(i, ["en", "fr", None][i % 3], t) for i, t in copies] + [(3, "en", "twice"), (3, "en", "twice"), (None, "en", "twice"), (None, "fr", None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 60)] + [(1, None, True), (2, 1, None), (None, 1, True), (3, 1, False)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, lang string, text string, part string, mask int").repartition(3)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit(frame, marked).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 3 * 600 and got == brute(docs, labels)
    assert filter_audit(frame.limit(0), marked).count() == 0
    assert filter_audit(frame, marked.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
