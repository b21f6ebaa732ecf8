import random
import re

import pytest

from heddle.operators import splitting


def groups_of(blocks, most, depth=0):
    """Groups by the heading at a depth; what is too large goes deeper if any block can."""
    out, key = [], object()
    for b in blocks:
        mine = b["path"][depth] if len(b["path"]) > depth else None
        if not out or mine != key:
            out.append([])
        key = mine
        out[-1].append(b)
    result = []
    for g in out:
        if sum(b["size"] for b in g) > most and any(len(b["path"]) > depth + 1 for b in g):
            result += groups_of(g, most, depth + 1)
        else:
            result.append(g)
    return result


def fill(groups, most):
    parts, held = [], 0
    for g in groups:
        size = sum(b["size"] for b in g)
        if not parts or held and held + size > most:
            parts.append([])
            held = 0
        parts[-1] += g
        held += size
    return parts


def table(seed):
    r = random.Random(seed)
    docs = {}
    for d in range(12):
        path, docs[d] = [], []
        for i in range(r.randrange(1, 60)):
            if r.random() < 0.4:
                path = [*path[: r.randrange(len(path) + 1)], f"h{r.randrange(3)}"][:6]
            docs[d].append({"idx": i, "size": r.choice([5, 20, 60, 90]) if r.random() < 0.97 else 150, "path": list(path)})
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_partitions(spark, seed):
    docs = table(seed)
    rows = [(d, b["idx"], b["size"], b["path"], 1) for d, bs in docs.items() for b in bs]
    frame = spark.createDataFrame(rows, "doc_id long, idx long, size long, path array<string>, extra int").repartition(5)
    got, groups, depths = {}, {}, set()
    for x in splitting.partitions(frame, ["doc_id"], 100).orderBy("doc_id", "part").collect():
        got.setdefault(x["doc_id"], []).append((x["first_idx"], x["blocks"], x["characters"], x["oversize"]))
    for x in splitting.semantic_groups(frame, ["doc_id"], 100).orderBy("doc_id", "idx").collect():
        groups.setdefault(x["doc_id"], {}).setdefault(x["grp"], []).append(x["idx"])
    for d, bs in docs.items():
        semantic = groups_of(bs, 100)
        assert list(groups[d].values()) == [[b["idx"] for b in g] for g in semantic]
        atomic = [g for s in semantic for g in (fill([[b] for b in s], 100) if sum(b["size"] for b in s) > 100 else [s])]
        assert got[d] == [(p[0]["idx"], len(p), sum(b["size"] for b in p), sum(b["size"] for b in p) > 100) for p in fill(atomic, 100)]
        depths |= {len(b["path"]) for b in bs}
    assert len(depths) > 4


def test_a_heading_ends_those_of_its_level_and_below(spark):
    sizes = [5, 15, 35, 25, 55, 8, 12]  # levels 1, 2, 4, 3, 6, 1, 2
    rows = [(1, i, "h" * n if i % 2 == 0 or True else "", True) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, idx long, text string, is_heading boolean")
    got = [[len(h) for h in r["path"]] for r in splitting.with_paths(frame).orderBy("idx").collect()]
    assert got == [[5], [5, 15], [5, 15, 35], [5, 15, 25], [5, 15, 25, 55], [8], [8, 12]]


def estimate(text):
    n = len(" ".join(re.split(r"[ \t\n\x0b\f\r]+", text)).strip(" "))
    return 0 if not n else max(1, -(-n * 2 // 7))


def plain_pieces(text, most):
    if estimate(text) <= most:
        return [text]
    units = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(units) == 1:
        units = [p.strip() for p in re.split(r"(?<=[.!?؟؛])\s+", text) if p.strip()]
    size, out, held, tokens = max(200, int(most * 3.5)), [], [], 0
    for u in units:
        if held and tokens + estimate(u) > most:
            out.append("\n\n".join(held))
            held, tokens = [], 0
        if estimate(u) > most:
            if held:
                out.append("\n\n".join(held))
            held, tokens = [], 0
            out += [s.strip() for s in (u[i : i + size] for i in range(0, len(u), size)) if s.strip()]
        else:
            held.append(u)
            tokens += estimate(u)
    return out + (["\n\n".join(held)] if held else [])


def test_pieces_hold_the_whole_text(spark):
    r = random.Random(3)
    words = ["one", "zwei", "trois.", "naïve", "日本", "end!", "x" * 300, "\n\n", "\n \n", "\n", "؟ ", "a"]
    texts = [None, "", " ", "y" * 900, "\n\n\n"] + [" ".join(r.choice(words) for _ in range(r.choice([3, 60, 200]))) for _ in range(60)]
    texts += [t.replace("\n", " ").replace(".", "") for t in texts[-6:] if t]
    frame = spark.createDataFrame([(k, t, "p") for k, t in enumerate(texts)], "k int, text string, piece string").drop("piece")
    got = {}
    for x in splitting.split_pieces(frame, "text", 60).orderBy("k", "piece").collect():
        got.setdefault(x["k"], []).append(x["text"])
    bare = lambda t: "".join(t.split())
    for k, text in enumerate(texts):
        assert got.get(k, []) == plain_pieces(text or "", 60), repr(text)
        assert bare("".join(got.get(k, []))) == bare(text or "")
        assert all(len(p) <= 210 + 400 for p in got.get(k, []))
