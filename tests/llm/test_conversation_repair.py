import hashlib
import random
import zlib
from functools import cache

import duckdb
import pytest

from heddle.llm import conversation_repair as cr
from heddle.llm.queries import ORACLE_SQL

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain(rows):
    """The contract for one conversation: all edits tried, cost first and audit second, over whole strings."""
    after = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in after:
        core = text.strip(SPACE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, *_ in after if t is not None]
    initials = [r[:1] for _, r, _ in after]
    legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def best(i, state, inserted=0):
        options = [(0, "", ())] if i == len(after) and state in (0, 3) else []
        if i < len(after):
            cost, audit, lines = best(i + 1, state)
            options.append((3 + cost, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra, role, text = int(faults[i] == "truncated"), after[i][1], after[i][2]
                if (state, role[:1]) in legal:
                    cost, audit, lines = best(i + 1, legal[state, role[:1]])
                    options.append((extra + cost, "K" + audit, (f"{role}:{text}", *lines)))
                for name in ("user", "assistant"):
                    if (state, name[0]) in legal:
                        cost, audit, lines = best(i + 1, legal[state, name[0]])
                        options.append((2 + extra + cost, "R" + audit, (f"{name}:{text}", *lines)))
        if inserted < 4:
            for name in ("user", "assistant"):
                if (state, name[0]) in legal:
                    cost, audit, lines = best(i, legal[state, name[0]], inserted + 1)
                    options.append((2 + cost, "I" + audit, (name + ":", *lines)))
        return min(options, default=(10**9, "~", ()))

    for i in range(len(after), -1, -1):  # so that long conversations don't recurse deeply
        for state in range(4):
            best(i, state)
    cost, audit, lines = best(0, 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def table(seed=3, long=700):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut", " \n", "", "é.", "Yes. ", "a.b", "x "]
    rows = []
    for conv in [*range(60), None]:
        for turn in r.sample(range(12), r.randrange(1, 10)):
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), r.choice([*texts, f"{conv}.", None])))
        if conv is None or conv % 7 == 0:
            rows += [(conv, None, r.choice(["user", "system", None]), r.choice(texts)) for _ in range(3)]
    rows += [(1000, t, r.choice(["user", "assistant", "system"]), r.choice([*texts, f"{t}?", f"{t}."])) for t in range(long)]  # one long conversation
    rows += [(1001, 5, "user", "same.")] * 40  # equal rows
    rows += [(1002, t, "assistant", "same again.") for t in range(90)]  # one text all the way
    rows += [(c, t, "user", "Gone.") for c in range(2000, 2400) for t in (0,)]  # some of them are dropped whole
    return rows


def by_conversation(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0], []).append(row)
    return {k: plain(v) for k, v in out.items()}


@pytest.mark.parametrize(("block", "size", "broadcast"), [(256, 1 << 20, 32 << 20), (3, 1 << 20, 0), (64, 12, 0)])
def test_rows_are_those_of_the_plain_version(spark, monkeypatch, block, size, broadcast):
    monkeypatch.setattr(cr, "BROADCAST", broadcast)
    rows = table()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int").repartition(4)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.repair(frame, block, size).collect()}
    expected = by_conversation(rows)
    assert set(got) == set(expected)
    for conv, row in expected.items():
        assert got[conv] == row, conv
    assert any(v[6] == "" for v in got.values()) and any("I" in v[6] for v in got.values()) and any("R" in v[6] for v in got.values())


def test_sql_gives_the_same_rows():
    rows = table(seed=4, long=40)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.execute(f"SELECT conv_id, {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_conversation_repair']})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == by_conversation(rows)


def test_each_suffix_is_made_once(monkeypatch):
    import pyarrow as pa

    made = []
    monkeypatch.setattr(cr, "extend", lambda symbol, rest, f=cr.extend: made.append(1) or f(symbol, rest))
    r = random.Random(2)
    words = sorted({"".join(r.choice("sauUAxd") for _ in range(r.randrange(9))) for _ in range(400)})
    batch = pa.RecordBatch.from_pydict({"ends": [""] * len(words), "reverse": words, "state": [0] * len(words)})
    out = list(cr._shared(iter([batch])))[0]
    assert len(made) == len({w[:k] for w in words for k in range(1, len(w) + 1)})
    for word, audit in zip(words, out.column("audit").to_pylist()):
        assert audit == cr.walk(0, word[::-1], cr.behind([cr.END], word[::-1], 0))[0]


def test_ends_are_few():
    ends, new = {cr.end_of(cr.END)}, [cr.END]
    while new:
        node = new.pop()
        for symbol in "sauxSAUXd":
            end = cr.end_of(cr.extend(symbol, node))
            if end not in ends:
                ends.add(end)
                new.append(cr.node_at(end))
    assert len(ends) < 60


def test_repaired_turns_follow_the_grammar(spark):
    import re

    rows = table(seed=5)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = {}
    for r in cr.repaired_turns(frame).collect():
        said.setdefault(r["conv_id"], []).append((r["block"], r["turn"], r["role"]))
    for turns in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for *_, role in sorted(turns)))


def test_empty_table(spark):
    assert cr.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
