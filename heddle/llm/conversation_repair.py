"""Damage of conversations, their faults, and the cheapest repair of their structure.

A row's symbol is its role's initial and its fault; a conversation's signature is its rows' symbols.  What the cheapest
repair costs from a row on, and which edits it takes, depends only on the signature's rest and on the state of
the grammar ``(s?(ua)+)?``.

1. Rows are told apart by a digest of role and text; those that occur more than once in a conversation are grouped, so that
   equal rows are one row with a number, and learn the turn at which they first occur.
2. One range shuffle puts all rows in the order of their conversations.  A task cuts what it sees of a conversation into
   blocks of at most ``BLOCK`` rows, so that nothing is held for a whole conversation, whatever its length, and a
   conversation that a third of all rows belong to is the work of many tasks.
3. A block's signature ends where the conversation does or at what its rest costs from each state, less the least of
   them: an ``end``, of which there are few.  Where a conversation has more blocks than one, its signatures - one byte a row -
   are read back to front for these ends and front to back for the state in which each block starts.
4. The distinct signatures of all conversations form an automaton that shares suffixes: sorted from their ends
   and dealt out by range, neighbours have their longest common suffix.  A task keeps the nodes of the current
   suffix only and makes each node once, with cost and best edit for each state; signatures that end alike share them.
5. The edits go back to the blocks by signature (dealt in ``SALT`` parts, as one signature may have a third of the
   blocks), and the repaired text of each conversation is hashed in order.

Among cheapest edits the first letters differ, and each letter leads to one node and state, so that the least letter
at each node gives the least audit.

Defined results: null role or text is one space; a null turn comes first; a null conv_id is a conversation of its own.
Rows of one turn are ordered by role, then by the digest of role and text.  An empty role has no initial and is never kept.
Other columns are not read; an empty table gives an empty result.  A digest of a whole text can only be made in order: the
repaired text of a conversation of several blocks flows, block by block, through one task, which holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import marked, marks, materialise, tasks_for

BLOCK = 256  # rows of a block
BLOCK_BYTES = 1 << 20  # of texts
SALT = 8
BROADCAST = 32 << 20  # bytes of edits that are broadcast; more are joined by a shuffle
DAMAGE = 20

#: The grammar: state -> (role that may follow, next state), besides a system row at the start.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 30

#: Symbols: a row that has to go; else its role's initial (``x``: any other), upper case if the row is truncated.
GONE = "d"

Node = tuple[tuple[int, ...], tuple[str, ...]]  # of each state: cost to go, and the best edit's initial


def _inserted(cost: list[int], edit: list[str]) -> Node:
    """Allows insertions in front."""
    for _ in range(3):  # the longest useful run of them passes three states
        for state, (_, after) in FOLLOWS.items():
            if (2 + cost[after], "I") < (cost[state], edit[state]):
                cost[state], edit[state] = 2 + cost[after], "I"
    return tuple(cost), tuple(edit)


#: Behind the last row: nothing or an assistant's turn may end a conversation.
END: Node = _inserted([0, NEVER, NEVER, 0], ["", "~", "~", ""])


def _kept(state: int, initial: str) -> int | None:
    if state == START and initial == "s":
        return SYSTEM
    role, after = FOLLOWS[state]
    return after if initial == role else None


def extend(symbol: str, rest: Node) -> Node:
    """The node of a row in front of ``rest``."""
    costs, edits = [], []
    for state in range(4):
        best = (3 + rest[0][state], "D")
        if symbol != GONE:
            extra = int(symbol.isupper())
            kept = _kept(state, symbol.lower())
            if kept is not None:
                best = min(best, (extra + rest[0][kept], "K"))
            best = min(best, (2 + extra + rest[0][FOLLOWS[state][1]], "R"))
        costs.append(best[0])
        edits.append(best[1])
    return _inserted(costs, edits)


def behind(stack: list[Node], signature: str, shared: int) -> list[Node]:
    """``stack`` of nodes from the end - the k-th stands in front of the last k rows - of which the first ``shared`` rows stay."""
    del stack[shared + 1 :]
    for symbol in reversed(signature[: len(signature) - shared]):
        stack.append(extend(symbol, stack[-1]))
    return stack


def walk(state: int, signature: str, stack: list[Node]) -> tuple[str, int]:
    """(initials of the edits, the state behind them)."""
    out, left = [], len(signature)
    while edit := stack[left][1][state]:
        out.append(edit)
        if edit == "K":
            state = _kept(state, signature[-left].lower())
        elif edit in "RI":
            state = FOLLOWS[state][1]
        left -= edit != "I"
    return "".join(out), state


def end_of(node: Node) -> str:
    """What a block needs to know of its rest."""
    least = min(node[0])
    return ",".join(str(c - least) for c in node[0])


def node_at(end: str) -> Node:
    """The node behind a block: ``END``, or one whose edits are not of this block."""
    return END if not end else (tuple(map(int, end.split(","))), ("",) * 4)


# Rows after damage


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage; ``n`` is 2 for a repeated row and 0 for a dropped one, which
    stays to tell of its conversation."""
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(said.cast("binary")) % DAMAGE
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key`` (digest of role and text) and ``first`` (a struct of the turn at which the conversation first
    has it, null if it has it once); rows of equal conversation, turn, role and text are one, with their number."""
    keyed = rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    keyed = keyed.withColumn("both", F.xxhash64(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "key"))
    light = keyed.where(F.col("n") > 0).groupBy("conv_id", "key", "both").agg(F.min(F.struct("turn")).alias("first"), F.sum("n").alias("times"))
    again = materialise(light.where(F.col("times") > 1).select("conv_id", "key", "both", "first"))
    # a bitmap of fixed size tells most rows that occur once; they aren't shuffled for this
    slot, bit = marked("both")
    flagged = keyed.withColumn("slot", slot).join(F.broadcast(marks(again, "both").withColumnsRenamed({"_slot": "slot", "_word": "word"})), "slot", "left")
    maybe = (F.col("n") > 0) & F.coalesce(F.col("word").bitwiseAND(bit) != 0, F.lit(False))
    columns = ["conv_id", "turn", "role", "text", "n", "key"]
    once = flagged.where(~maybe).select(*columns, F.lit(None).cast(again.schema["first"].dataType).alias("first"))
    more = flagged.where(maybe).groupBy("conv_id", "turn", "role", "key").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    known = again.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    joined = more.join(known, more["conv_id"].eqNullSafe(known["c"]) & (more["key"] == known["k"]), "left")
    return once.unionByName(joined.select(*columns, "first"))


def in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, symbol, fault) of all rows, dealt out by range and sorted; the first of ``n`` equal rows
    has ``symbol`` and ``fault`` (blank, duplicate, truncated or null), the others are duplicates or blank."""
    rows = _told_apart(damaged(conversations))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    earlier = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(last == "", "blank").when(earlier, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    placed = rows.withColumn("fault", fault).select(
        "conv_id", "turn", "role", "key", "text", "n", "fault", F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter).alias("symbol")
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "key")]
    return placed.repartitionByRange(tasks_for(placed), *order).sortWithinPartitions(*order).drop("key")


_BLOCK = "at long, inner boolean, signature string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, opens string, closes string"


def _cut(rows: int, size: int):
    """Sorted rows to blocks.  ``inner``: the whole of a conversation, of which no other task can have rows."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        names = [part.split()[0] for part in _BLOCK.split(", ")]
        conv, block, held, done, split, convs = None, None, 0, [], False, 0

        def opened() -> dict:
            return {"signature": [], "roles": [], "texts": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "low": None, "high": None, "opens": None, "closes": None}

        def close(inner: bool) -> None:
            nonlocal at
            block["signature"] = "".join(block["signature"])
            done.append((conv, at, inner, *(block[k] for k in names[2:])))
            at += 1

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, turn, role, text, n, fault, symbol in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "n", "fault", "symbol"))):
                if block is None or (c is None) != (conv is None) or c != conv:
                    if block is not None:
                        close(not split and convs > 1)
                    conv, block, held, split, convs = c, opened(), 0, False, convs + 1
                initial = role[:1]
                for k in range(n):
                    if k == 1:
                        fault, symbol = "blank" if fault == "blank" else "duplicate", GONE
                    if len(block["signature"]) >= rows or held and held + len(text) > size:
                        close(False)
                        block, held, split = opened(), 0, True
                    if block["closes"] is None:
                        block["opens"] = initial
                    elif block["closes"] + initial not in ("su", "ua", "au"):
                        block["illegal"] += 1
                    block["closes"] = initial
                    if turn is not None and turn != block["high"]:
                        block["turns"] += 1
                        block["high"] = turn
                        block["low"] = turn if block["low"] is None else block["low"]
                    if fault:
                        block[fault] += 1
                    block["signature"].append(symbol)
                    block["roles"].append(role)
                    block["texts"].append(text if symbol != GONE else "")
                    held += len(text)
            if done:
                yield _table(done, names, kind)
                done = []
        if block is not None:
            close(False)
            yield _table(done, names, kind)

    def _table(rows_of: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows_of))
        types = [kind, pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, types)], names=["conv_id", *names])

    return body


# Blocks of longer conversations


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, at, signature) of each conversation from its last block on: what each block ends with."""
    conv, end, begun = None, "", False
    known: dict = {}
    for batch in batches:
        out = []
        for c, signature in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if not begun or c != conv:
                conv, end, begun = c, "", True
            out.append(end)
            if (end, signature) not in known:
                known = {} if len(known) > 1 << 14 else known
                known[end, signature] = end_of(behind([node_at(end)], signature, 0)[-1])
            end = known[end, signature]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string())], names=[*batch.schema.names, "ends"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, at, signature, ends) from the first block on: the state in which each block starts."""
    conv, state, begun = None, START, False
    for batch in batches:
        out = []
        for c, signature, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if not begun or c != conv:
                conv, state, begun = c, START, True
            out.append(state)
            state = walk(state, signature, behind([node_at(end)], signature, 0))[1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.int32())], names=[*batch.schema.names, "state"])


def _chained(edge: DataFrame) -> DataFrame:
    """(at, ends, state) of blocks that may not be the only ones of their conversation."""
    kind = edge.schema["conv_id"].dataType.simpleString()
    n, light = tasks_for(edge), edge.select("conv_id", "at", "signature")
    back = light.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_ends, f"conv_id {kind}, at long, signature string, ends string")
    forth = back.repartition(n, "conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_states, f"conv_id {kind}, at long, signature string, ends string, state int")
    return forth.select("at", "ends", "state")


# The automaton


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (ends, reversed signature, state), sorted: the best edits.  Only the nodes of the current suffix are held."""
    end, last, stack = None, "", []
    for batch in batches:
        out = []
        for e, reverse, state in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if e != end:
                end, last, stack = e, "", [node_at(e)]
            common = next((k for k, (x, y) in enumerate(zip(last, reverse)) if x != y), min(len(last), len(reverse)))
            last = reverse
            out.append(walk(state, reverse[::-1], behind(stack, reverse[::-1], common))[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.string())], names=["ends", "reverse", "state", "audit"])


def best_edits(signatures: DataFrame) -> DataFrame:
    """(ends, signature, state, audit) of the distinct ``signatures`` (ends, signature, state)."""
    words = signatures.select("ends", F.reverse("signature").alias("reverse"), "state").distinct()
    placed = words.repartitionByRange(tasks_for(words), "ends", "reverse").sortWithinPartitions("ends", "reverse")
    out = placed.mapInArrow(_shared, "ends string, reverse string, state int, audit string")
    return out.select("ends", F.reverse("reverse").alias("signature"), "state", "audit")


# Repair


def repaired_rows(state: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """(role, text) of the rows that a block's edits leave."""
    out, i = [], 0
    for edit in audit:
        if edit in "RI":
            role, state = FOLLOWS[state]
            out.append((ROLES[role], texts[i] if edit == "R" else ""))
        elif edit == "K":
            state = _kept(state, roles[i][:1])
            out.append((roles[i], texts[i]))
        i += edit != "I"
    return out


def _cost(audit: str, signature: str) -> int:
    out, i = 0, 0
    for edit in audit:
        out += {"K": 0, "R": 2, "I": 2, "D": 3}[edit] + (edit in "KR" and signature[i].isupper())
        i += edit != "I"
    return out


_PART = "at long, inner boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, opens string, closes string, cost long, audit string, repaired string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their edits: ``repaired`` is the digest if the block is a whole conversation, else the text."""
    kept = [part.split()[0] for part in _PART.split(", ")][:-3]
    for batch in batches:
        cost, audits, texts = [], batch.column("audit").to_pylist(), []
        for inner, state, audit, signature, roles, said in zip(*(batch.column(k).to_pylist() for k in ("inner", "state", "audit", "signature", "roles", "texts"))):
            text = "\n".join(f"{role}:{words}" for role, words in repaired_rows(state, audit, roles, said))
            cost.append(_cost(audit, signature))
            texts.append(hashlib.sha256(text.encode()).hexdigest() if inner else text)
        arrays = [pa.array(cost, type=pa.int64()), pa.array(audits, type=pa.string()), pa.array(texts, type=pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *map(batch.column, kept), *arrays], names=["conv_id", *kept, "cost", "audit", "repaired"])


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired blocks, in order, to conversations; what is held of a conversation is its counts, digest and audit."""
    names = ("conv_id", *(part.split()[0] for part in _PART.split(", ")))
    conv, one = None, None

    def result() -> pa.RecordBatch:
        row = [_gaps(one["low"], one["high"], one["turns"]), *(one[k] for k in _COUNTS), one["cost"], "".join(one["audit"]), one["digest"].hexdigest()]
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip([conv, *row], types)], names=["conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for values in zip(*(batch.column(k).to_pylist() for k in names)):
            block = dict(zip(names, values))
            if one is None or block["conv_id"] != conv:
                if one is not None:
                    yield result()
                conv = block["conv_id"]
                one = dict.fromkeys((*_COUNTS, "cost", "turns"), 0) | {"low": None, "high": None, "closes": None, "audit": [], "digest": hashlib.sha256(), "lines": False}
            for k in (*_COUNTS, "cost", "turns"):
                one[k] += block[k]
            if block["opens"] is not None:
                one["illegal"] += one["closes"] is not None and one["closes"] + block["opens"] not in ("su", "ua", "au")
                one["closes"] = block["closes"]
            if block["low"] is not None:
                one["turns"] -= block["low"] == one["high"]
                one["low"] = block["low"] if one["low"] is None else one["low"]
                one["high"] = block["high"]
            one["audit"].append(block["audit"])
            if block["repaired"]:
                one["digest"].update((b"\n" if one["lines"] else b"") + block["repaired"].encode())
                one["lines"] = True
    if one is not None:
        yield result()


def blocks_with_edits(conversations: DataFrame, rows: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """All blocks with the edits of the cheapest repair: the columns of ``_BLOCK``, ends, state, audit."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    blocks = materialise(in_order(conversations).mapInArrow(_cut(rows, size), f"conv_id {kind}, {_BLOCK}"))
    inner, edge = blocks.where("inner"), blocks.where(~F.col("inner"))
    chained = materialise(_chained(edge))
    every = inner.withColumns({"ends": F.lit(""), "state": F.lit(START)}).unionByName(edge.join(chained, "at"))
    edits = materialise(best_edits(inner.select(F.lit("").alias("ends"), "signature", F.lit(START).alias("state")).unionByName(edge.select("at", "signature").join(chained, "at").select("ends", "signature", "state"))))
    held = edits.agg(F.sum(F.length("signature") + F.length("audit") + 32)).head()[0] or 0
    keys = ["ends", "signature", "state"]
    if held <= BROADCAST:
        return every.join(F.broadcast(edits), keys)
    salted = edits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return every.withColumn("salt", F.pmod("at", F.lit(SALT)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def repair(conversations: DataFrame, rows: int = BLOCK, size: int = BLOCK_BYTES) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    parts = blocks_with_edits(conversations, rows, size).mapInArrow(_repaired, f"conv_id {kind}, {_PART}")
    parts = materialise(parts)
    gaps = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = parts.where("inner").select("conv_id", gaps.cast("long").alias("gaps"), *_COUNTS, "cost", "audit", F.col("repaired").alias("repaired_sha256"))
    more = parts.where(~F.col("inner")).repartition(tasks_for(parts), "conv_id").sortWithinPartitions("conv_id", "at")
    return whole.unionByName(more.mapInArrow(_joined, f"conv_id {kind}, gaps long, {', '.join(f'{k} long' for k in _COUNTS)}, cost long, audit string, repaired_sha256 string"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("state", "audit", "roles", "texts")]
        rows = [[{"role": role, "text": text} for role, text in repaired_rows(*one)] for one in zip(*columns)]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(rows, type=kind)], names=["conv_id", "at", "rows"])


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, block (their order), turn (from 0 in its block), role, text."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    out = blocks_with_edits(conversations).mapInArrow(_turns, f"conv_id {kind}, at long, rows array<struct<role: string, text: string>>")
    return out.select("conv_id", F.col("at").alias("block"), F.posexplode("rows").alias("turn", "r")).select("conv_id", "block", "turn", "r.role", "r.text")
