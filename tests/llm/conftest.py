import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, blanks of all kinds, nulls and repeated rows."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("Ab", "ce", "dö", "ef", "ñi", "x-") for b in range(40)]

    def text(n):
        return " ".join(rng.choices(vocabulary, k=n))

    passage, line = text(70), text(25)
    rows = []
    for i in range(60):
        body = text(rng.choice([0, 1, 2, 5, 40, 120, 300]))
        if i % 4 == 0:
            body += "\n" + passage + "\t " + text(30)
        if i % 5 == 0:
            body = line + "\n" + body + "\n" + line
        rows.append((i * 3, body))
    for i in range(25):  # a family with few to many edits each, so that links form chains
        words = rows[9][1].split() or text(150).split()
        base = (words * 4)[:180]
        for _ in range(i):
            base[rng.randrange(180)] = rng.choice(vocabulary)
        rows.append((500 + i, " ".join(base)))
    rows += [(700 + i, rows[7][1]) for i in range(12)]
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], text(60)), (None, passage), (None, None), (801, None), (802, ""), (803, " \x0b\x0c\r\n"),
             (804, "one"), (805, "one two"), (806, ("same " * 400).strip()), (807, ("same " * 130).strip()), (808, "x" * 70000), (809, "\x00 a\x1fb \x85c d")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with columns whose names the operators use themselves."""
    kinds = "doc_id long, text string, tag string, doc long, vertex int, n_words long, source string, items string"
    return spark.createDataFrame([(i, t, "t", 5, 1, 2, "s", None) for i, t in corpus], kinds).repartition(5)
