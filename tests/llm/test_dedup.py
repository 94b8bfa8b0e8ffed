"""Substring, line and near-duplicate operators against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelwise.llm import neardups, substrings
from reelwise.llm.components import components
from reelwise.llm.lines import dedup_lines
from reelwise.llm.neardups import near_duplicates
from reelwise.llm.substrings import remove_repeats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_repeats(rows, window):
    lists = [WORDS.findall(text or "") for _, text in rows]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, lists):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window,hot", [(35, 4000), (35, 2), (8, 4000), (3, 1), (2, 4000)])
def test_substrings(spark, copies, clashing, window, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    done = remove_repeats(clashing, window)
    assert done.columns == ["doc_id", "text", "row", "key", "c0", "n_words", "n_removed", "kept"]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in done.collect())
    assert got == brute_repeats(copies, window)


def test_substrings_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, None), (2, "x y")], "doc_id long, text string")
    assert [(r.n_removed, r.kept) for r in remove_repeats(df, 3).orderBy("doc_id").collect()] == [(0, ""), (4, ""), (4, ""), (0, "x y")]
    assert remove_repeats(df.limit(0), 35).count() == 0


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = [len(holders[key(x)]) < min_docs or doc == max(holders[key(x)]) for x in lines]
        out.append((doc, len(lines), keep.count(False), "\n".join(x for x, k in zip(lines, keep) if k)))
    return sorted(out)


@pytest.mark.parametrize("min_chars,min_docs,batch", [(40, 5, 10000), (4, 2, 3), (1, 3, 7)])
def test_lines(spark, copies, clashing, min_chars, min_docs, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = dedup_lines(clashing, min_chars, min_docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in rows) == brute_lines(copies, min_chars, min_docs)
    for r in rows:
        if r.keep is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines)
            assert r.n_lines - bits.sum() == r.n_dropped


def test_lines_edges(spark):
    text = "x" * 50
    df = spark.createDataFrame([(None, text), (None, text), (3, text + "\nend"), (3, text), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.kept) for r in dedup_lines(df, 40, 2).collect()), key=repr)
    assert got == sorted([(None, ""), (None, ""), (3, text + "\nend"), (3, text), (4, "")], key=repr)
    assert dedup_lines(df.limit(0)).count() == 0


def brute_near(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((doc, len(s), find(doc), find(doc) == doc) for doc, s in sets.items())


@pytest.mark.parametrize("size,percent,region,family", [(3, 85, 200, 1000), (5, 80, 200, 1000), (3, 85, 30, 4), (3, 60, 200, 5)])
def test_near_duplicates(spark, copies, clashing, size, percent, region, family, monkeypatch):
    monkeypatch.setattr(neardups, "REGION", region)
    monkeypatch.setattr(neardups, "FAMILY", family)
    rows = near_duplicates(clashing, size, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == brute_near(copies, size, percent)


def edited(copies, words, edits, length, seed):
    """Near copies of one text of distinct words, each with `edits` own runs of `length` new words."""
    draw, rows = random.Random(seed), []
    for i in range(copies):
        own = [f"w{k}" for k in range(words)]
        for e in range(edits):
            at = draw.randrange(words - length)
            own[at : at + length] = [f"x{i}e{e}n{k}" for k in range(length)]
        rows.append((i, " ".join(own)))
    return rows


def test_near_duplicates_alike_in_every_value(spark, monkeypatch):
    monkeypatch.setattr(neardups, "REGION", 5)
    monkeypatch.setattr(neardups, "FAMILY", 6)
    rows = edited(20, 3000, 1, 5, 1)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_duplicates_of_a_crowded_region(spark, monkeypatch):
    monkeypatch.setattr(neardups, "REGION", 2)
    rows = edited(80, 300, 1, 3, 2)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_near(rows, 5, 80)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a B"), (2, None), (2, None), (3, " "), (5, "q"), (5, "r s")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (1, 1, None, False), (2, 0, 2, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (5, 1, 5, True)], key=repr)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    pairs = [(9, 8), (8, 7), (7, 6), (6, 1), (20, 21), (5, 5), (30, 31), (31, 32), (30, 32), (8, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 6: 1, 1: 1, 20: 20, 21: 20, 30: 30, 31: 30, 32: 30}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n)), "".join("ba"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_any_power_hash(spark):
    """Two words of 1,024 letters whose polynomial hashes modulo 2^64 agree for every base are different words."""
    one, other = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, one), (4, other)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(df, 35).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert all(r.kept for r in near_duplicates(df.filter("doc_id > 2"), shingle=3, percent=85).collect())


def test_many_copies_beside_near_copies(spark):
    words = [f"w{i}" for i in range(90)]
    near = [" ".join([*words[:20], f"x{i}", *words[20:]]) for i in range(40)]
    rows = [" ".join(words)] * 300 + near + [" ".join(words[30:70]) + " end", "short"] + ["short one"] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7)
    for r in remove_repeats(df, 35).collect():
        text = rows[r.doc_id].split()
        wanted = 0 if len(text) < 35 else len(text) if r.doc_id < 300 else 40 if text[-1] == "end" else 70
        assert (r.n_words, r.n_removed) == (len(text), wanted)
