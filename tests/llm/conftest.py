import random

import pytest


@pytest.fixture(autouse=True)
def own_workers(request, spark, monkeypatch):
    """Tests of what workers hold get workers that no other test has used: another environment starts others."""
    if request.module.__name__.endswith("test_worker_memory"):
        monkeypatch.setitem(spark.sparkContext.environment, "REELWISE_TEST", request.node.name)


@pytest.fixture(scope="session")
def copies():
    """Texts with exact copies, near copies, shared passages and lines, short, blank, null and long ones."""
    draw = random.Random(3)
    words = ["w" + "".join(draw.choice("aeiouBCÉß") for _ in range(4)) for _ in range(300)]

    def prose(n):
        return "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\n", "\t", ", "]) for _ in range(n))

    passage, line = prose(60), " ".join(draw.choice(words) for _ in range(12))
    rows = []
    for i in range(40):
        rows.append(prose(draw.choice([0, 1, 2, 5, 36, 80, 200])))
    for _ in range(3):
        base = prose(150)
        rows += [base] * 3
        for _ in range(8):
            parts = base.split(" ")
            for _ in range(draw.choice([0, 1, 2, 4, 9])):
                parts[draw.randrange(len(parts))] = draw.choice(words)
            rows.append(" ".join(parts))
    rows += [prose(20) + passage + prose(30) for _ in range(4)]
    rows += [prose(5) + "\n " + line.upper() + " \n" + prose(9) + "\n" + line + "\n" for _ in range(7)]
    rows += [None, "", "  \n ", "one", "one two", "one TWO", "a " * 90, "b b " * 60, prose(6000)]
    draw.shuffle(rows)
    return [(i, text) for i, text in enumerate(rows)]


@pytest.fixture(scope="session")
def clashing(spark, copies):
    """The same texts as a table whose other columns carry names the operators use themselves."""
    rows = [(i, text, "x", i, "y", "z", 1) for i, text in copies]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, key long, kept string, n_words string, c0 int").repartition(3)
