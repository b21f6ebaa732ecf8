import random
import re
from collections import Counter
from math import log

from pyspark.sql import functions as F

from heddle.operators import textindex

WORDS = ["Été", "ete", "river", "stone", "łódź", "a", "über", "uber", "ñandú", "of", "the", "42", "straße"]


def test_index_is_read_by_bucket_and_ranks_like_plain_bm25(spark, tmp_path):
    r = random.Random(1)
    rows = [(d, i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 14))), [r.choice(WORDS) for _ in range(r.randrange(3))]) for d in range(12) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, idx long, text string, path array<string>")
    index = textindex.build(frame, f"{tmp_path}/index")
    queries = {1: ["ete", "river"], 2: ["uber", "nandu", "42"], 3: ["nothing"], 4: ["łodz"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "q int, term string")
    found = index.search(asked, ["q"], 5)
    plain = lambda t: t.lower().replace("é", "e").replace("ü", "u").replace("ñ", "n").replace("ú", "u").replace("ó", "o").replace("ź", "z")
    fields = {(d, i): re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain(" / ".join([*p, t]))) for d, i, t, p in rows}
    fields = {k: w for k, w in fields.items() if w}
    mean, df = sum(map(len, fields.values())) / len(fields), Counter(t for w in fields.values() for t in set(w))
    got = {}
    for x in found.orderBy("q", "place").collect():
        got.setdefault(x["q"], []).append((x["doc_id"], x["idx"], round(x["score"], 6)))
    for q, ts in queries.items():
        scores = {}
        for k, w in fields.items():
            if set(ts) & set(w):
                scores[k] = sum(log(1 + (len(fields) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ts if t in w)
        assert got.get(q, []) == [(*k, round(s, 6)) for k, s in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]]
    one = index.postings(spark.createDataFrame([("river",)], "term string"))
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert one.agg(F.count("*")).head()[0] == df["river"]


def test_packs_keep_evidence_and_fill_the_rest(spark):
    r = random.Random(2)
    b = [(d, i, r.choice([5, 10, 30]), r.choice("xy" if d % 2 else "z")) for d in range(4) for i in range(15)]
    claims = [(d, s, r.randrange(15)) for d in range(4) for s in "pq" for _ in range(r.randrange(1, 5))]
    hits = [(d, s, i, k + 1) for d in range(4) for s in "pq" for k, i in enumerate(r.sample(range(15), 6))]
    got = textindex.evidence_packs(
        spark.createDataFrame(claims, "doc_id long, segment string, idx long"), spark.createDataFrame(b, "doc_id long, idx long, tokens long, source string"),
        spark.createDataFrame(hits, "doc_id long, segment string, idx long, place int"), F.when(F.col("source") == "x", 2).when(F.col("source") == "y", 1).otherwise(0), (F.col("claims") * 40).cast("long"),
    )
    got = {(x["doc_id"], x["segment"]): x for x in got.collect()}
    size, far = {(d, i): t for d, i, t, _ in b}, {(d, i): {"x": 2, "y": 1, "z": 0}[s] for d, i, _, s in b}
    for d, s in {c[:2] for c in claims}:
        own = [c[2] for c in claims if c[:2] == (d, s)]
        originals, budget = sorted(set(own)), 40 * len(own)
        room, names = max(0, budget - sum(size[d, i] for i in originals)), []
        for i in originals:
            for step in range(1, far[d, i] + 1):
                if (d, i - step) in size:
                    names.insert(0, i - step)
                if (d, i + step) in size:
                    names.append(i + step)
        near = len(names)
        names += [h[2] for h in hits if h[:2] == (d, s)]
        seen, taken, counts = set(originals), [], [0, 0]
        for k, i in enumerate(names):
            if i not in seen and size[d, i] <= room:
                seen.add(i)
                taken.append(i)
                room -= size[d, i]
                counts[k >= near] += 1
        x = got[d, s]
        assert (x["originals"], x["claims"], x["budget"], x["context"], x["neighbours"], x["hits"]) == (len(originals), len(own), budget, ",".join(map(str, taken)), *counts)
        assert x["actual_tokens"] == sum(size[d, i] for i in [*originals, *taken])
    assert any(x["hits"] for x in got.values()) and any(x["neighbours"] for x in got.values())


def test_letters_without_marks(spark):
    texts = ["Été naïve Łódź", "éa", "ǍǙẦ ﬁ", ""]
    got = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(textindex.plain_letters(F.col("t"))).collect()]
    assert got == ["ete naive łodz", "ea", "aua ﬁ", ""]


def test_terms_are_stored_once_with_their_numbers_of_blocks(spark, tmp_path):
    rows = [(1, 0, "river stone river", ["Stone"]), (1, 1, "river", []), (2, 0, "...", [])]
    index = textindex.build(spark.createDataFrame(rows, "doc_id long, idx long, text string, path array<string>"), f"{tmp_path}/index")
    assert sorted((r["term"], r["df"]) for r in index.terms().collect()) == [("river", 2), ("stone", 1)]
    got = sorted((r["term"], r["doc_id"], r["idx"], r["tf"], r["words"], r["df"]) for r in index.postings().collect())
    assert got == [("river", 1, 0, 2, 4, 2), ("river", 1, 1, 1, 1, 2), ("stone", 1, 0, 2, 4, 1)]


def test_scores_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    rows = [(None if d == 3 else d % 40, i, " ".join(r.choice(WORDS) for _ in range(r.randrange(0, 14))), []) for d in range(44) for i in range(20)]  # four documents share their ids with others
    index = textindex.build(spark.createDataFrame(rows, "doc_id long, idx long, text string, path array<string>"), f"{tmp_path}/index")
    asked = [(q, None if q == 5 else "x", t) for q in range(6) for t in r.sample(["ete", "river", "uber", "42", "łodz", "the", "nothing"], 4)] + [(2, "x", "stone"), (2, "x", "stone")]
    queries = spark.createDataFrame(asked, "q int, `a b` string, term string")
    monkeypatch.setattr(textindex, "SCORES", 60, raising=False)
    found = index.search(queries, ["q", "a b"], 4)
    got = sorted(found.collect(), key=str)
    rows_of = found.groupBy("q").count().collect()
    assert {x["q"]: x["count"] for x in rows_of} == dict.fromkeys(range(6), 4)
    monkeypatch.setattr(textindex, "ASKED", 0, raising=False)
    assert got == sorted(index.search(queries, ["q", "a b"], 4).collect(), key=str)
    assert "postings" not in "".join(found.inputFiles())  # these are met term by term, with a shuffle of every score
