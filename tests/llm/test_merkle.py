"""Merkle trees against a plain statement, with few levels per partition so that the exchange has rounds."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradeflow.llm import merkle as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def tree(nodes, fanout):
    """(root, for each node its siblings as (left, right) per level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            low = place - place % fanout
            paths[i].append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + fanout])))
        at = [x // fanout for x in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([k[2] for k, _ in sorted(groups[s], key=lambda x: x[0])], fanout) for s in order]
    root, over = tree([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, paths), above in zip(order, trees, over):
        for (k, r), path in zip(sorted(groups[s], key=lambda x: x[0]), paths):
            out.append((r[0], k[2], subroot, root, path + above))
    return out


KINDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, block int, pos string"


def made(sizes, seed=1):
    rng = random.Random(seed)
    rows = [(1000 * k + i, s, rng.choice(["de", None, ""]), rng.choice([None, i]), rng.choice(["", None, "a\nb", f"é {i}\n", "x" * 30]))
            for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return rows + [rows[0]] * 2 + [(None, rows[0][1], None, None, None), (rows[0][0], rows[0][1], None, 1, "other")]


@pytest.mark.parametrize("fanout, depth", [(3, 7), (3, 1), (3, 0), (2, 2), (4, 1)])
def test_proofs_equal_the_plain_tree(spark, fanout, depth):
    rows = made({None: 1, "": 5, "a": 82, "é": 28, "b": 3, "zz": 1, "hot": 200, **{f"s{i:02}": 1 for i in range(20)}})
    df = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], KINDS).repartition(4)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, list(zip(r.lefts, r.rights))) for r in m.proofs(m.leaf_rows(df), fanout, depth).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, fanout), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 12, 27, 28, 31, 82])
def test_exchange_of_ragged_trees(spark, n):
    """Every partition gets the root and its siblings, whatever the size of the last subtree."""
    rows = [(i, "only", "x", i, None) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = [(r.doc_id, r.leaf, r.subroot, r.root, list(zip(r.lefts, r.rights))) for r in m.proofs(m.leaf_rows(df), 3, 0).collect()]
    assert sorted(got) == sorted(plain(rows, 3))


def test_a_change_does_not_prove(spark):
    rows = [(i, "ab"[i % 2], "x", 1, f"text {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    now = F.struct("doc_id", "source", "lang", "n_chars", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")).alias("text"))
    found = m.audit(df.withColumn("now", F.when(F.col("doc_id") > 3, now)), depth=1).collect()
    assert {r.doc_id for r in found if not r.verified} == {7} and len(found) == 50
    assert all(r.proof_sha256 == h(*[x + y for x, y in p[4]]) for r, p in zip(sorted(found), sorted(plain(rows, 3))))


def test_empty_table(spark):
    empty = spark.createDataFrame([], KINDS)
    assert m.proofs(m.leaf_rows(empty)).count() == 0
