"""Merkle manifest of a data set: a tree of digests per group, and one over the groups.

Nodes of a tree are cut into partitions of ``fanout ** LEVELS`` neighbours. A task builds
the lower levels of a partition by itself. The upper levels are a butterfly exchange: in
round j the partitions of a tree form aligned groups of ``fanout ** (j + 1)``, made up of
``fanout`` subtrees; every partition gets the roots of the other subtrees from a partner in
each, and hashes the common parent for itself, as do all others of the group. So each
partition ends up with the root and with all siblings on its way there, in
log(partitions) rounds, and nothing is sent down the tree. If the last subtree of a group is
smaller than the others, its members take the places of the missing partners by turns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gradeflow.llm.catalog import register
from gradeflow.llm.groups import runs
from gradeflow.llm.ranks import in_order, with_positions
from gradeflow.session import materialize

FANOUT = 3
#: Levels within a partition: 2,187 nodes at a fanout of 3.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def row_digest(*fields: Column) -> Column:
    """Digest of values: '-' for null, else the number of UTF-8 bytes, a colon and the value as a text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def levels_of(nodes: list[str], fanout: int, least: int) -> list[list[str]]:
    """``nodes`` and the levels above them, until one node is left and ``least`` levels are built."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        below = out[-1]
        out.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[str]], place: int, fanout: int) -> Iterator[tuple[str, str]]:
    """(left, right) siblings of a node and of its ancestors, below the top of ``levels``."""
    for level in levels[:-1]:
        low = place - place % fanout
        yield "".join(level[low:place]), "".join(level[place + 1 : low + fanout])
        place //= fanout


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _partition_root(fanout: int, depth: int):
    def run(batches):
        for table, cuts in runs(batches, ("tree", "block")):
            nodes = table["digest"].to_pylist()
            at = pa.array(cuts[:-1])
            least = np.where(table["n"].to_numpy()[cuts[:-1]] > fanout**depth, depth, 0)  # a tree in one partition ends at its root
            tops = [levels_of(nodes[a:z], fanout, d)[-1][0] for a, z, d in zip(cuts[:-1], cuts[1:], least)]
            yield pa.record_batch([*(table[c].take(at).combine_chunks() for c in ("tree", "block")), pa.array(
                -(-table["n"].to_numpy()[cuts[:-1]] // fanout**depth), pa.int64()), pa.array(tops)], names=["tree", "block", "m", "digest"])

    return run


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _round(state: DataFrame, span: int, fanout: int) -> DataFrame:
    """One round for trees of more than ``span`` partitions: swap roots of subtrees of ``span`` partitions, hash parents."""
    own = F.floor(F.col("block") / span) * span  # first partition of the own subtree
    held = F.least(F.lit(span), F.col("m") - own)
    group = F.floor(F.col("block") / (span * fanout)) * (span * fanout)

    def towards(d: int) -> Column:
        """The partitions of the d-th subtree that this one is the partner of; of its own subtree, itself."""
        start = group + d * span
        first, last = start + F.col("block") - own, F.least(start + span, F.col("m")) - 1
        other = F.when(first <= last, F.sequence(first, last, held)).otherwise(F.array().cast("array<bigint>"))
        return F.when(start == own, F.array(F.col("block"))).otherwise(other)

    to = F.flatten(F.array(*[towards(d) for d in range(fanout)]))
    sent = state.select("tree", "m", "block", F.explode(to).alias("to"), ((own - group) / span).cast("int").alias("d"), "digest", "lefts", "rights")
    here = F.col("to") == F.col("block")
    met = sent.groupBy("tree", F.col("to").alias("block")).agg(
        F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("d", "digest"))).alias("roots"),
        F.max(F.when(here, F.col("d"))).alias("own"), F.max(F.when(here, F.col("lefts"))).alias("lefts"),
        F.max(F.when(here, F.col("rights"))).alias("rights"))  # a subtree sends one root: at most ``fanout`` in a list

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("roots", keep), lambda r: r["digest"]), "")

    return met.select(
        "tree", "block", "m", F.sha2(joined(lambda r: F.lit(True)), 256).alias("digest"),
        F.concat("lefts", F.array(joined(lambda r: r["d"] < F.col("own")))).alias("lefts"),
        F.concat("rights", F.array(joined(lambda r: r["d"] > F.col("own")))).alias("rights"))


def butterfly(partitions: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, block, root, lefts, rights) for stored rows (tree, block, m, digest): all partitions of each tree.

    ``lefts`` and ``rights`` hold, level by level, the digests left and right of the way to the root.
    """
    none = F.array().cast("array<string>")
    state = partitions.select("tree", "block", "m", "digest", none.alias("lefts"), none.alias("rights"))
    most = partitions.agg(F.max("m")).first()[0] or 0
    span, done = 1, []
    while span < most:
        done.append(state.where(F.col("m") <= span))
        state = materialize(_round(state.where(F.col("m") > span), span, fanout), "butterfly")
        span *= fanout
    for part in done:
        state = state.unionByName(part)
    return state.withColumnRenamed("digest", "root").drop("m")


def _paths(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(tree, block, root, lefts, rights): the upper proof of each partition of ``nodes`` (tree, pos, n, digest)."""
    rows = nodes.select("tree", "block", "pos", "n", "digest")
    tops = _together(rows).mapInArrow(_partition_root(fanout, depth), "tree long, block long, m long, digest string")
    return butterfly(materialize(tops, "partition-roots"), fanout)


SCHEMA = "doc_id long, leaf string, subroot string, root string, lefts array<string>, rights array<string>"
HEAD = ("lefts", "rights", "subroot", "root")


def _walk(fanout: int, depth: int, finish: Callable, schema: pa.Schema):
    """``finish(row, path, upper)`` for each node; the upper proof of a partition comes as the row before its nodes."""

    def run(batches):
        for table, cuts in runs(batches, ("tree", "block")):
            uppers = table.select(HEAD).take(pa.array(cuts[:-1])).to_pylist()
            n = table["n"].take(pa.array(cuts[:-1] + 1)).to_numpy()
            least = np.where(n > fanout**depth, depth, 0)
            kept = table.drop_columns(list(HEAD))
            for a, z, d, upper in zip(cuts[:-1].tolist(), cuts[1:].tolist(), least, uppers):
                rows = kept.slice(a + 1, z - a - 1).to_pylist()
                levels = levels_of([r["digest"] for r in rows], fanout, d)
                above = list(zip(upper["lefts"], upper["rights"]))
                out = [finish(r, [*siblings(levels, i, fanout), *above], upper) for i, r in enumerate(rows)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _each(nodes: DataFrame, paths: DataFrame, fanout: int, depth: int, finish: Callable, schema: str) -> DataFrame:
    heads = paths.withColumn("pos", F.lit(-1).cast("long"))
    rows = _together(nodes.unionByName(heads, allowMissingColumns=True))
    kinds = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)
    return rows.mapInArrow(_walk(fanout, depth, finish, kinds), schema)


def _source_row(row: dict, path: list, upper: dict) -> dict:
    return {"source": row["source"], "root": upper["root"], "lefts": [x for x, _ in path], "rights": [x for _, x in path]}


def proof_row(row: dict, path: list, upper: dict) -> dict:
    """A leaf with its roots and the digests left and right of its way up, level by level."""
    return {"doc_id": row["key"], "leaf": row["digest"], "subroot": upper["subroot"], "root": upper["root"],
            "lefts": [x for x, _ in path], "rights": [x for _, x in path]}


def proofs(leaves: DataFrame, fanout: int = FANOUT, depth: int = LEVELS, finish: Callable = proof_row, schema: str = SCHEMA) -> DataFrame:
    """A row per leaf with its proof, for rows (part, key, digest) and any columns that ``finish`` reads.

    Leaves of a part are in the order of key (nulls first) and digest, parts in the order of their bytes (null first);
    the roots of the parts are the leaves of the tree over them. Repeated rows are leaves of their own.
    An empty table gives no rows.
    """
    size = fanout**depth
    extra = [c for c in leaves.columns if c not in ("part", "key", "digest")]
    ordered = in_order(leaves, ["part", "key", "digest", *extra], "leaves")
    placed = with_positions(ordered, "part")
    nodes = placed.select(F.col("first").alias("tree"), F.floor(F.col("pos") / size).alias("block"), "pos", "n", "key", "digest", *extra)
    paths = materialize(_paths(nodes, fanout, depth).withColumnRenamed("root", "subroot"), "proofs")
    # the tree over the parts
    parts = in_order(paths.where("block = 0").select("tree", F.col("subroot").alias("digest")), ["tree"], "subroots")
    top = with_positions(parts, None).select(
        F.lit(0).cast("long").alias("tree"), F.floor(F.col("pos") / size).alias("block"), "pos", "n", "digest", F.col("tree").alias("source"))
    top = materialize(top, "subroots")
    over = _paths(top, fanout, depth).withColumn("subroot", F.lit(None).cast("string"))
    over = _each(top, over, fanout, depth, _source_row, "source long, root string, lefts array<string>, rights array<string>")
    over = materialize(over, "roots").withColumnsRenamed({"lefts": "over_lefts", "rights": "over_rights"})
    upper = paths.join(over, F.col("tree") == F.col("source")).select(
        "tree", "block", F.concat("lefts", "over_lefts").alias("lefts"), F.concat("rights", "over_rights").alias("rights"), "subroot", "root")
    return _each(nodes, upper, fanout, depth, finish, schema)


def leaf_rows(docs: DataFrame, key: str = "doc_id", part: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(part, key, digest): the digest of the named fields of each row. Null and empty values differ; other columns are not read."""
    return docs.select(F.col(part).cast("string").alias("part"), F.col(key).cast("long").alias("key"),
                       row_digest(*[F.col(f) for f in fields]).alias("digest"))


AUDIT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _audit(row: dict, path: list, upper: dict) -> dict:
    folded = fold(row["digest"] if row["seen"] is None else row["seen"], path)
    return {"doc_id": row["key"], "leaf": row["digest"], "subroot": upper["subroot"], "root": upper["root"],
            "proof_sha256": digest("".join(left + right for left, right in path)), "folded_root": folded, "verified": folded == upper["root"]}


def audit(docs: DataFrame, fanout: int = FANOUT, depth: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``, and whether the version of each row in the struct column ``now`` still proves against its root.

    A row whose ``now`` is null is held to be unchanged.
    """
    fields = [F.col(f"now.{f}") for f in FIELDS]
    leaves = docs.select(
        F.col("source").cast("string").alias("part"), F.col("doc_id").cast("long").alias("key"),
        row_digest(*[F.col(f) for f in FIELDS]).alias("digest"), F.when(F.col("now").isNotNull(), row_digest(*fields)).alias("seen"))
    return proofs(leaves, fanout, depth, _audit, AUDIT)


def _root() -> str:
    """Merkle levels of a table ``leaves(tree, pos, digest)`` by recursion; then the same over the sources."""
    def tree(name: str, leaves: str) -> str:
        return f"""{name} as (select 0 as level, tree, pos, digest, count(*) over (partition by tree) n from {leaves}
      union all select * from (select level + 1 as level, tree, pos // 3 as pos, sha256(string_agg(digest, '' order by pos)) digest,
        any_value((n + 2) // 3) n from {name} where n > 1 group by level, tree, pos // 3))"""

    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x if x != "text" else text) for x in FIELDS) + ")"
    # CRC-32 of the digits, bit by bit
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(xor(c, b) // 2, 3988292384 * (xor(c, b) % 2)), 4294967295::bigint), 4294967295::bigint)"
    odd = "replace(text, chr(10), '')"
    return f"""with recursive rows_ as (select doc_id, {leaf('text')} leaf, case when {crc} % 2 = 0 then {leaf(odd)} else {leaf('text')} end seen,
      dense_rank() over (order by source nulls first) tree from documents),
    placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 pos from rows_),
    leaves as (select tree, pos, leaf digest from placed),
    {tree('nodes', 'leaves')},
    subroots as (select tree, digest from nodes where n = 1),
    top as (select 0 tree, row_number() over (order by tree) - 1 pos, digest from subroots),
    {tree('over_', 'top')},
    tops as (select max(level) depth from over_),
    depths as (select tree, max(level) depth from nodes group by tree),
    -- the way of each row up to the root: node numbers by level, first in its source's tree, then over the sources
    way as (select p.doc_id, p.leaf, p.seen, p.tree, p.pos, l as level, 'n' kind, p.pos // (3 ** l)::bigint num, p.tree t
        from placed p join depths d using (tree), lateral (select unnest(range(0, d.depth)) l)
      union all select p.doc_id, p.leaf, p.seen, p.tree, p.pos, l + 1000, 'o', (p.tree - 1) // (3 ** l)::bigint, 0
        from placed p, tops d, lateral (select unnest(range(0, d.depth)) l)),
    every as (select 'n' kind, tree t, level, pos, digest from nodes union all select 'o', tree, level + 1000, pos, digest from over_),
    beside as (select w.tree, w.pos, w.level, coalesce(string_agg(e.digest, '' order by e.pos) filter (e.pos < w.num), '') l,
        coalesce(string_agg(e.digest, '' order by e.pos) filter (e.pos > w.num), '') r
      from way w join every e on e.kind = w.kind and e.t = w.t and e.level = w.level and e.pos // 3 = w.num // 3 group by all),
    paths as (select tree, pos, list({{'l': l, 'r': r}} order by level) path from beside group by tree, pos),
    full_ as (select p.*, coalesce(path, []) path from placed p left join paths using (tree, pos)),
    folded as (select *, list_reduce(list_transform(path, lambda x: [x.l, x.r]), lambda c, x: [sha256(x[1] || c[1] || x[2]), ''], [seen, ''])[1] folded_root
      from full_)
    select doc_id, leaf, s.digest subroot, (select digest from over_ where n = 1) root,
      sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) proof_sha256, folded_root,
      folded_root = (select digest from over_ where n = 1) verified
    from folded join subroots s using (tree)"""


@register("op11_merkle_manifest", _root())
def op11(spark, folder: str) -> DataFrame:
    """Half of the documents lose their line breaks; they no longer prove."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    bare = F.struct(*[F.translate("text", "\n", "").alias("text") if f == "text" else F.col(f) for f in FIELDS])
    return audit(docs.withColumn("now", F.when(even, bare)))
