"""Repair of conversations whose turns are missing, repeated, empty, cut off or out of turn.

All turns are put in one order (conversation, turn) and cut into blocks of neighbouring
turns, whatever conversation they are of, so a conversation of any length is spread over as
many tasks as it has blocks. In a block the cheapest edits of each conversation that lies
inside it are found by the survivors of a Viterbi search (see ``survivors``). Where a
conversation crosses the edge of a block, the search runs from every state that the turns before
may have led to; these few ways per block are then put together, in the order of the blocks, by
the same search, with the ways of a block in the place of the edits of a turn.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gradeflow.llm import survivors as S
from gradeflow.llm.catalog import register
from gradeflow.llm.groups import runs
from gradeflow.llm.ranks import in_order
from gradeflow.session import materialize

#: A block has at most 2 ** BLOCK_BITS turns.
BLOCK_BITS = 10
#: Bytes of repaired text that travel in one row.
PIECE_BYTES = 1 << 20
# White space, and the characters that end a complete turn.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = {"su", "ua", "au"}
WAYS = S.STATES * S.STATES

RUN = "block long, run int, conv {key}, open boolean, illegal long, first string, last string, cost long, audit string, " \
      "costs array<long>, orders array<int>, audits array<string>"
CHOICE = "block long, run int, way int, tail string, cost long, illegal long"
EDIT = "block long, run int, open boolean, conv {key}, turn {turn}, edit string, role string, text string"
PIECE = "block long, run int, piece int, open boolean, conv {key}, sha string, body binary"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _search(state: int, turns: list[tuple]) -> S.Survivors:
    search = S.Survivors(state)
    for turn in turns:
        search.turn(*turn)
    return search


def _closed(turns: list[tuple]) -> dict:
    cost, edits, tail = _search(S.START, turns).finish()
    return {"open": False, "cost": cost, "audit": "".join(edits) + tail}


def _opened(turns: list[tuple]) -> dict:
    """Costs, edits and order of the ways from each state to each; null where there is none."""
    costs, orders, audits = [None] * WAYS, [None] * WAYS, [None] * WAYS
    for before in range(S.STATES):
        search = _search(before, turns)
        for after, cost in search.cost.items():
            i = before * S.STATES + after
            costs[i], orders[i] = cost, search.rank[after]
            audits[i] = "".join(search.done + search.edits_to(after))
    return {"open": True, "costs": costs, "orders": orders, "audits": audits}


def _block(schema: pa.Schema):
    """Runs of turns of one conversation in a block. The first and the last one may go on in other blocks."""

    def run(batches):
        for table, cuts in runs(batches, ("block",)):
            rows = table.to_pylist()
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                starts = [i for i in range(a, z) if i == a or rows[i]["conv"] != rows[i - 1]["conv"]]
                out = []
                for number, (low, high) in enumerate(zip(starts, [*starts[1:], z])):
                    part = rows[low:high]
                    turns = [(r["initial"], r["blank"] or r["duplicate"], r["truncated"]) for r in part]
                    initials = [t[0] for t in turns]
                    found = _opened(turns) if low == a or high == z else _closed(turns)
                    out.append({"block": part[0]["block"], "run": number, "conv": part[0]["conv"], "illegal": _illegal(initials),
                                "first": initials[0], "last": initials[-1], **found})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _link(schema: pa.Schema):
    """One way through the blocks of each conversation; rows come in the order of conversation, block, run."""

    def ways(row: dict) -> Iterator[tuple]:
        for i, cost in enumerate(row["costs"]):
            if cost is not None:
                label = {"block": row["block"], "run": row["run"], "way": i, "tail": "", "cost": 0, "illegal": 0}
                yield i // S.STATES, i % S.STATES, cost, label, row["orders"][i]

    def end(search: S.Survivors, illegal: int) -> list[dict]:
        cost, labels, tail = search.finish()
        return [*labels[:-1], {**labels[-1], "tail": tail, "cost": cost, "illegal": illegal}]

    def run(batches):
        search, conv, last, illegal, out = None, None, "", 0, []
        for b in batches:
            for row in b.to_pylist():
                if search is None or row["conv"] != conv:
                    if search is not None:
                        out += end(search, illegal)
                    search, conv, illegal = S.Survivors(), row["conv"], 0
                else:
                    illegal += last + row["first"] not in LEGAL
                last = row["last"]
                # what is certain leaves, but for the newest, which takes the figures of the whole
                out += search.done[:-1]
                search.done = search.done[-1:]
                search.extend(ways(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if search is not None:
            yield pa.RecordBatch.from_pylist(end(search, illegal), schema=schema)

    return run


def _apply(schema: pa.Schema):
    """Turns with their edits; the edits of a block's runs come ahead of its turns."""

    def run(batches):
        heads: deque[dict] = deque()
        block, conv, head, letters, state = None, None, None, iter(()), S.START

        def inserted():
            nonlocal state
            role, state = next((r, s) for r, s in S.FOLLOWS[state].items() if r in S.INSERTED)
            return {**own, "turn": None, "edit": S.INSERT_LETTER, "role": S.INSERTED[role], "text": ""}

        left: list[str] = []
        own: dict = {}
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row["kind"] == 0:
                    heads.append(row)
                    continue
                if head is None or row["block"] != block or row["conv"] != conv:
                    out += [inserted() for _ in left]
                    head, block, conv = heads.popleft(), row["block"], row["conv"]
                    own = {"block": block, "run": head["run"], "open": head["open"], "conv": conv}
                    left, state = list(reversed(head["audit"])), head["state"]
                while left[-1] == S.INSERT_LETTER:
                    left.pop()
                    out.append(inserted())
                letter = left.pop()
                role, text = row["role"], row["text"]
                if letter == S.DELETE_LETTER:
                    role = text = None
                elif letter == S.REROLE_LETTER:
                    initial, state = next((r, s) for r, s in S.FOLLOWS[state].items() if r in S.INSERTED)
                    role = S.INSERTED[initial]
                else:
                    state = S.FOLLOWS[state][role[:1]]
                out.append({**own, "turn": row["turn"], "edit": letter, "role": role, "text": text})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if left:
            yield pa.RecordBatch.from_pylist([inserted() for _ in left], schema=schema)

    return run


def _pieces(schema: pa.Schema):
    """``role:text`` of the kept turns, each after a line break: the digest of a whole run, or its bytes in pieces."""

    def run(batches):
        own, body, size, piece, hashed = None, [], 0, 0, None

        def row(sha=None, data=None):
            return {**own, "piece": piece, "sha": sha, "body": data}

        def close():
            if own["open"]:
                return [row(data=b"".join(body))] if body else []
            return [row(sha=hashed.hexdigest())]

        for b in batches:
            out = []
            for r in b.to_pylist():
                key = {k: r[k] for k in ("block", "run", "open", "conv")}
                if key != own:
                    out += close() if own else []
                    own, body, size, piece, hashed, begun = key, [], 0, 0, hashlib.sha256(), False
                if r["role"] is None:
                    continue
                data = f"\n{r['role']}:{r['text']}".encode()
                if not own["open"]:
                    hashed.update(data if begun else data[1:])
                    begun = True
                    continue
                body.append(data)
                size += len(data)
                if size >= PIECE_BYTES:
                    out.append(row(data=b"".join(body)))
                    body, size, piece = [], 0, piece + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if own:
            yield pa.RecordBatch.from_pylist(close(), schema=schema)

    return run


def _hash(schema: pa.Schema):
    """One digest per conversation from its pieces, in their order, without the first line break."""

    def run(batches):
        conv, hashed = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                data = row["body"]
                if hashed is None or row["conv"] != conv:
                    if hashed is not None:
                        out.append({"conv": conv, "sha": hashed.hexdigest()})
                    conv, hashed, data = row["conv"], hashlib.sha256(), data[1:]
                hashed.update(data)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if hashed is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": hashed.hexdigest()}], schema=schema)

    return run


def _mapped(rows: DataFrame, task, ddl: str) -> DataFrame:
    return rows.mapInArrow(task(to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)), ddl)


@dataclass
class Repair:
    """``ordered``: the turns; ``faults``: their flags; ``edits``: the cheapest edits of each run of turns in a block."""

    ordered: DataFrame
    faults: DataFrame
    edits: DataFrame

    def turns(self) -> DataFrame:
        """A row per turn and edit, in the order of block and place: conv, turn, edit, role and text.

        A deleted turn has no role and text, an inserted one no turn and an empty text.
        """
        kinds = dict(self.ordered.dtypes)
        block = F.shiftright("seq", BLOCK_BITS).alias("block")
        heads = self.edits.select(F.lit(0).alias("kind"), "block", F.col("run").cast("long").alias("seq"), "run", "open", "state", "audit")
        rows = self.ordered.select(F.lit(1).alias("kind"), block, "seq", "conv", "turn", "role", "text")
        rows = rows.unionByName(heads, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "kind", "seq")
        return _mapped(rows, _apply, EDIT.format(key=kinds["conv"], turn=kinds["turn"]))

    def digests(self) -> DataFrame:
        """(conv, sha): SHA-256 of the kept and inserted turns as ``role:text`` lines, for conversations that have any.

        A digest is sequential, so the pieces of a conversation that crosses blocks are streamed through one
        task, which holds one batch of them.
        """
        kind = dict(self.ordered.dtypes)["conv"]
        pieces = materialize(_mapped(self.turns(), _pieces, PIECE.format(key=kind)), "pieces")
        opened = pieces.where("open").select("conv", "block", "run", "piece", "body")
        opened = opened.repartition("conv").sortWithinPartitions("conv", "block", "run", "piece")
        return pieces.where("not open").select("conv", "sha").unionByName(_mapped(opened, _hash, f"conv {kind}, sha string"))

    def report(self) -> DataFrame:
        """A row per conversation that has turns: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha.

        ``gaps`` counts numbers missing between the least and the largest turn; ``audit`` is the whole row of edits.
        """
        each = self.faults.groupBy("conv", "turn").agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in FAULTS])
        counts = each.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(c).alias(c) for c in FAULTS])
        runs_of = F.sort_array(F.collect_list(F.struct("block", "run", "audit")))
        edits = self.edits.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.transform(runs_of, lambda r: r["audit"]), "").alias("audit"))
        parts = counts.unionByName(edits, allowMissingColumns=True).unionByName(self.digests(), allowMissingColumns=True)
        figures = [c for c in parts.columns if c != "conv"]
        return parts.groupBy("conv").agg(*[F.max(c).alias(c) for c in figures])


FAULTS = ("blank", "duplicate", "truncated")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Find the cheapest edits that give each conversation the roles ``(s?(ua)+)?``, by role initials.

    Turns are taken by number, null first; of turns that share a number, by role, then by a hash of the text; a
    repeated row follows the first. A null role or text reads as one space. Each turn has at most one fault: blank (white
    space alone), duplicate (its role and text came earlier), truncated (its last visible character ends no sentence). Rows
    without a key are one conversation. An empty table gives empty results; other columns are not read.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    rows = rows.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    ordered = in_order(rows, ["conv", "turn", "role", "said"], "turns")
    firsts = ordered.groupBy("conv", "said").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    body = F.rtrim("text", F.lit(BLANKS))
    narrow = ordered.select("seq", "conv", "turn", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"),
                            (~F.right(body, F.lit(1)).isin(*ENDS)).alias("cut"))
    flags = narrow.join(firsts, "seq", "left").withColumn("duplicate", ~F.col("blank") & F.col("is_first").isNull())
    flags = flags.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut")).drop("cut", "is_first")
    faults = materialize(flags.withColumn("block", F.shiftright("seq", BLOCK_BITS)), "faults")
    by_block = faults.repartition("block").sortWithinPartitions("block", "seq")
    found = materialize(_mapped(by_block, _block, RUN.format(key=dict(rows.dtypes)["conv"])), "runs")
    opened = found.where("open").select("conv", "block", "run", "first", "last", "costs", "orders")
    opened = opened.repartition("conv").sortWithinPartitions("conv", "block", "run")
    chosen = materialize(_mapped(opened, _link, CHOICE), "ways").withColumnsRenamed({"cost": "whole_cost", "illegal": "between"})
    edits = found.join(chosen, ["block", "run"], "left").select(
        "block", "run", "conv", "open", F.coalesce(F.floor(F.col("way") / S.STATES), F.lit(S.START)).cast("int").alias("state"),
        F.coalesce(F.concat(F.get("audits", F.col("way")), F.col("tail")), F.col("audit")).alias("audit"),
        F.coalesce("cost", "whole_cost").alias("cost"), (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"))
    return Repair(ordered, faults, materialize(edits, "edits"))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of ``conv_id:turn``; nulls read as one space."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    rows = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy")).drop("copy")


@register("op12_conversation_repair")
def op12(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    report = repair(damage(rows)).report()
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    # conversations that lost all rows have no line in the report
    both = report.unionByName(every, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return both.groupBy(F.col("conv").alias("conv_id")).agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
