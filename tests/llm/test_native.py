"""The two operators that use DataFrame functions only."""

import hashlib
import re
import zlib
from collections import Counter

from reelwise.llm.contamination import NO_ID, contamination, phrase_matches, stored_tokens
from reelwise.llm.quality import quality_rules

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def brute_hits(docs, items, size):
    windows = {}
    for item, text in items:
        w = terms(text)
        for s in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, held = terms(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    held |= windows[tuple(w[s : s + n])]
        out.append((doc, len(w), len(hit), len(held - {None}), sorted(str(i) for i in held - {None})))
    return sorted(out)


def items_for(copies):
    long = [t for _, t in copies if t and len(terms(t)) > 60]
    joined = " ".join(terms(long[0])[5:30])
    return [(1, joined), (2, joined.upper() + "!"), (10, " ".join(terms(long[1])[:4])), (3, "absent words only here"), (4, None), (5, "..."), (None, " ".join(terms(long[2])[3:15])), (6, "a a a a a a a a a a a a"), (7, "one")]


def test_contamination(spark, copies, clashing):
    items = items_for(copies)
    frame = spark.createDataFrame(items, "item_id long, text string")
    for size in (10, 3):
        rows = contamination(clashing, frame, size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in rows) == brute_hits(copies, items, size)


def test_contamination_edges(spark):
    docs = spark.createDataFrame([(1, "x the end"), (1, "x the end"), (None, "The END"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the end")], "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, items).collect()), key=repr)
    assert got == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 2, 2, True), (2, 0, 0, False)], key=repr)
    assert contamination(docs, items.limit(0)).filter("contaminated").count() == 0
    assert contamination(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "beta filler alpha gamma"), (2, "alpha beta gamma"), (3, "gamma " + "x " * 20 + "alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found, _ = phrase_matches(docs, stored_tokens(docs, "doc_id", "text"), items, 3, slop=2)
    assert {(r.doc, r.exact) for r in found.collect()} == {(1, False), (2, True), (2, False)}


def base_of(text):
    text = text or ""
    w = WORDS.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(spark, copies, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules(clashing, labels).collect()
    texts = dict(copies)
    assert len(rows) == len(copies)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_of(texts[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert quality_rules(clashing.limit(0), labels).count() == 0


def test_quality_score_heeds_word_order(spark):
    words = [f"w{k}" for k in range(60)]
    other = words[::2] + words[1::2]
    frame = spark.createDataFrame([(i, " ".join(other if i % 2 else words)) for i in range(400)], "doc_id long, text string")
    labels = frame.selectExpr("doc_id", "int(doc_id % 2 = 0) AS quality")
    scores = {r.doc_id: r.score for r in quality_rules(frame, labels).collect()}
    assert min(s for i, s in scores.items() if i % 2 == 0) > max(s for i, s in scores.items() if i % 2) + 0.1


def test_quality_learns(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), labels.select("doc_id", "quality")).collect()
    marked = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.kept, marked[r.doc_id]) for r in rows if r.doc_id in marked and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good = [kept for kept, label in held if label == 1]
    bad = [kept for kept, label in held if label == 0]
    assert sum(good) / len(good) > 0.9 and sum(bad) / len(bad) < 0.2, (sum(good) / len(good), sum(bad) / len(bad))
