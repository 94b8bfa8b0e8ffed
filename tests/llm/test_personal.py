"""Personal data: base spans against plain patterns, and what the trees add."""

import random
import re

import pytest

from reelwise.llm.personal import KINDS, best_split, matches, personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return out


def spans(row, name="base"):
    return [(x.kind, x.start, x.end) for x in row[name]]


def card(draw, size=16, good=True):
    while True:
        d = "".join(draw.choice("0123456789") for _ in range(size))
        if luhn(d) == good:
            return d


def pieces(draw):
    """Fragments that the patterns nearly match, and words between them."""
    short = [".", "-", " ", "+", "@", "(", ")", "_", "%", ":", "\n", "é", "\U0001f600", "x", "at", "dot", "[.]", " ", "//"]
    long = [
        "a.b@c.de", "a@b.c_d@e.f", "me@host", "@x.y", "a@.b", "a@b..c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.0.00.1", "99999999999999999999.1.1.1", "+1 (234) 555-0199",
        "+1+22 333 4444", "+12", "+1 2", "(234) 555-0199", "234-555-0199", "1234 5678", card(draw), card(draw, good=False), card(draw, 19), card(draw, 20), card(draw, 13), card(draw, 15, False),
    ]
    grouped = card(draw)
    long.append(" ".join(grouped[i : i + 4] for i in range(0, 16, 4)))
    long.append("-".join(grouped[i : i + 4] for i in range(0, 16, 4)) + " 7")
    long.append("/".join(grouped[i : i + 4] for i in range(0, 16, 4)))
    return "".join(draw.choice(draw.choice([short, long])) for _ in range(draw.choice([1, 3, 8, 30, 300])))


def test_base(spark, copies):
    draw = random.Random(8)
    texts = [pieces(draw) for _ in range(400)] + [t for _, t in copies] + [None, "", "a" * 200_000, "1" * 100_000 + ".", "1-" * 50_000, "b@" + "c." * 20_000 + "d", "+1 234 56789 " * 2_000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, found int").repartition(4)
    rows = personal_data(df).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert spans(r) == brute(texts[r.doc_id]), texts[r.doc_id][:300]
        assert set(spans(r)) <= set(spans(r, "spans")) and (r.row, r.found) == ("x", 1)
        own = [s for s in spans(r, "spans") if s not in spans(r)]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in own for b in spans(r) + [o for o in own if o != a])


def letters(n):
    """Documents with confirmed and refuted values of each kind, and spelled-out ones to find."""
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("bcdfgaeiou") for _ in range(draw.randint(2, 8)))
    rows, wanted = [], []
    for i in range(n):
        tel = f"({draw.randint(200, 999)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}"
        parts = [word() for _ in range(10)]
        parts += [f"mail {word()}.{word()}@{word()}.com", f"tel +1 {tel}", f"{word()}@{word()}", f"order {draw.randint(10, 99)} 200 {draw.randint(300, 999)}"]
        parts += [f"version {draw.randint(300, 999)}.{draw.randint(1, 9)}.{draw.randint(1, 9)}.7", f"host 10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.9", f"code +{draw.randint(10, 99)} 5"]
        found = None
        if i % 10 == 0:
            found = draw.choice([f"{word()}.{word()} (at) {word()} (dot) com", f"({draw.randint(200, 999)}) {draw.randint(200, 999)}-{draw.randint(1000, 9999)}", "10[.]20[.]30[.]9"])
            parts.append({"(": "tel ", "1": "host "}.get(found[0], "mail ") + found)
        draw.shuffle(parts)
        rows.append((i, ", ".join(parts)))
        wanted.append(found)
    return rows, wanted


def test_trees_add_open_spans(spark):
    rows, wanted = letters(600)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    caught = clean = false = 0
    for r in personal_data(df).collect():
        text = rows[r.doc_id][1]
        extra = [text[s : e] for k, s, e in spans(r, "spans") if (k, s, e) not in spans(r)]
        if wanted[r.doc_id]:
            caught += wanted[r.doc_id] in extra
        else:
            clean += 1
            false += bool(extra)
    assert caught >= 0.8 * 60 and false <= 0.02 * clean, (caught, false, clean)


def test_nothing_to_learn(spark):
    rows = [(None, "(234) 555-0199 and +1 234 555 0199"), (1, None), (1, None), (2, "x (at) y (dot) com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((spans(r), spans(r, "spans")) for r in personal_data(df).collect())
    assert got == [([], []), ([], []), ([], []), ([("phone", 19, 34)], [("phone", 19, 34)])]
    assert personal_data(df.limit(0)).count() == 0


def test_best_split():
    cells = {"a": {1: (-3.0, 2.0), 2: (-2.0, 2.0), 8: (5.0, 3.0)}, "b": {0: (0.0, 7.0)}}
    assert best_split(cells)[:2] == ("a", 5)
    assert best_split({"b": {0: (0.0, 7.0)}}) is None


@pytest.mark.parametrize("block", [1, 64])
def test_positions(spark, monkeypatch, block):
    import reelwise.llm.personal as personal

    monkeypatch.setattr(personal, "BLOCK", block)
    text = "é1 22\U0001f600 333,4" * 50
    df = spark.createDataFrame([(text,), ("",)], "_text string")
    row = matches(df, "n", "[0-9]+", "true").collect()[0]
    assert [(x.start, x.v) for x in row._n] == [(m.start(), m[0]) for m in re.finditer("[0-9]+", text)]
    assert all(text[: x.start].endswith(x.before) for x in row._n) and KINDS
