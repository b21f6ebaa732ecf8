import random
import re
import unicodedata
from itertools import groupby
from statistics import median

from pyspark.sql import functions as F

from heddle.operators import readings


def test_normalised_texts(spark):
    r = random.Random(5)
    bits = ["ﬁ", "Ⅳ", "½", "é", "é", "ي", "ك", "٤", "۵", "ً", "‎", "‏", "‌", " ", "  ", "\n", " ", " ", "(", ")", "،", "!", "a", "ß", "ｆｕｌｌ", "😀", "%", "]"]
    texts = [None, "", " ( a ) , b !"] + ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(150)]

    def plain(text, keep):
        t = unicodedata.normalize("NFKC", text or "")
        t = t.translate(str.maketrans(readings.LETTERS_FROM + readings.DIGITS_FROM, readings.LETTERS_TO + readings.DIGITS_TO))
        t = re.sub(readings.MARKS, "", t).replace("‎", "").replace("‏", "")
        t = t if keep else t.replace("‌", " ")
        t = " ".join(t.split())
        return re.sub(r"([(\[{])\s+", r"\1", re.sub(r"\s+([،؛؟!,.:%)\]}])", r"\1", t))

    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for keep in (True, False):
        got = {x["k"]: x["n"] for x in frame.select("k", readings.normalised(F.col("t"), keep).alias("n")).collect()}
        assert got == {k: plain(t, keep) for k, t in enumerate(texts)}


def test_spoken_chunks(spark):
    r = random.Random(6)
    words = ["a", "word.", "longer", "x" * 25, "end!", "why?", "\n", "two"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in range(60)] + ["", "  ", "y" * 70]

    def plain(text, most):
        out, current = [], ""
        for s in (p.strip() for p in re.split(r"(?<=[.!?؟؛])\s+", " ".join(text.split()))):
            if len(s) > most:
                out += [current] if current else []
                current, held = "", []
                for w in s.split():
                    if held and len(" ".join([*held, w])) > most:
                        out.append(" ".join(held))
                        held = []
                    held.append(w)
                out += [" ".join(held)]
            elif s:
                both = f"{current} {s}".strip()
                if current and len(both) > most:
                    out.append(current)
                    current = s
                else:
                    current = both
        return out + ([current] if current else [])

    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k int, text string, chunk int").drop("chunk")
    got = {}
    for x in readings.spoken_chunks(frame, "text", ["k"], 30).orderBy("k", "chunk").collect():
        got.setdefault(x["k"], []).append(x["text"])
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain(t, 30), t


def runs(paths, depth):
    """Runs of one heading, those without one added to the run before or the first."""
    out = []
    for key, group in groupby(enumerate(paths), lambda x: x[1][depth] if len(x[1]) > depth else None):
        places = [i for i, _ in group]
        if key is None and out:
            out[-1][1].extend(places)
        elif out and out[-1][0] is None:
            out[-1] = [key, out[-1][1] + places]
        else:
            out.append([key, places])
    return [places for _, places in out]


def plain_chapters(paths):
    n, by = len(paths), [runs(paths, 0), runs(paths, 1)]
    number = [{i: c for c, places in enumerate(r, 1) for i in places} for r in by]
    depth = next((d for d in (0, 1) if len(by[d]) >= 2 and median(map(len, by[d])) >= 8 and max(map(len, by[d])) <= 0.6 * n), None)
    toc = len(by[0]) >= 2
    if depth is not None and toc:
        other = sum(number[depth][i] != number[0][i] for i in range(n)) / n
        agreed = other <= 0.2 and all(0.02 * n <= len(p) <= 0.4 * n for p in by[depth])
        return ("agreed", number[depth]) if agreed else ("disagreed", number[0])
    if depth is not None:
        return "heading_only", number[depth]
    return ("toc_only", number[0]) if toc else ("single", dict.fromkeys(range(n), 1))


def test_chapters(spark):
    r = random.Random(7)
    docs, rows = {}, []
    for d in range(80):
        path, docs[d] = [], []
        change = r.choice([0.03, 0.08, 0.3])
        for i in range(r.randrange(1, 90)):
            if r.random() < change:
                kind = r.choice(["top", "sub", "none"] if d % 3 else ["sub"])
                path = [f"h{r.randrange(4)}"] if kind == "top" else [path[0] if path else "h0", f"s{r.randrange(4)}"] if kind == "sub" else []
            docs[d].append(list(path))
            rows.append((d, i, list(path), "x"))
    frame = spark.createDataFrame(rows, "doc_id long, idx long, path array<string>, verdict string").drop("verdict").repartition(4)
    got, seen = {}, set()
    for x in readings.chapters(frame).collect():
        got.setdefault(x["doc_id"], {})[x["idx"]] = (x["chapter"], x["verdict"])
    for d, paths in docs.items():
        verdict, number = plain_chapters(paths)
        seen.add(verdict)
        assert got[d] == {i: (number[i], verdict) for i in range(len(paths))}, d
    assert seen >= {"agreed", "disagreed", "toc_only", "single"}
