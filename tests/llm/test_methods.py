"""That the results come through the methods named, each against a plain version of the method."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from heddle.llm import decontaminate, jaccard_join, language_id, quality, shard_ring, toxicity, url_filter
from heddle.llm.trees import condition
from heddle.llm.wordgrams import gram_hashes, words_of

SYLLABLES = ["ba", "ke", "li", "no", "ru", "ta", "mo", "si", "fe", "du"]


def prose(rng, n, bad=()):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for w in bad:
        words.insert(rng.randrange(n), w)
    return " ".join(words)


def toxic_rows(n):
    rng = random.Random(3)
    return [(i, prose(rng, 120, rng.choices(["zwgrump", "xqvile", "hjwretch"], k=5) if i % 4 == 0 else ()), int(i % 4 == 0)) for i in range(n)]


def test_toxic_documents_are_told_by_two_dictionaries(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.ordinary) <= toxicity.DICTIONARY and len(model.toxic) <= toxicity.DICTIONARY
    assert b"xqvile" in model.toxic and b"xqvile" not in model.ordinary
    out = [r for r in toxicity.toxicity(docs, model).collect() if r["held_out"]]
    assert len(out) > 80 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out) >= 0.95 * len(out)


def test_distances_are_differences_of_compressed_lengths():
    ordinary, toxic = b"balikeno mosi tadu feru " * 8, b" zwgrump xqvile"
    texts = [b"", b"x", b"balike zwgrump mosi xqvile tadu nokelifesi", "añb ".encode() * 9]
    got, counts = toxicity.Distance(ordinary, toxic).of_windows(texts)
    expected = []
    for text in texts:
        for a in range(0, max(1, len(text) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            window = toxicity.LEAD + text[a : a + toxicity.WINDOW]
            lengths = [len(zstandard.ZstdCompressor.compress(toxicity._compressor(d), window)) for d in (ordinary, toxic)]
            expected.append(lengths[0] - lengths[1])
    assert got.tolist() == expected and counts.sum() == len(expected) and max(expected) > 2


def test_toxicity_finds_inflected_words_and_not_repetition():
    """Toxic words of one stem and many endings; ordinary texts that repeat a few words hundreds of times."""
    rng = random.Random(5)
    parts = "er st an in on ver le de que au ei oi ch ta ro mi sa".split()
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 4)))

    def ordinary():
        if rng.random() < 0.3:
            return " ".join(w for w in (word() for _ in range(6)) for _ in range(rng.randint(40, 80)))
        return " ".join(word() for _ in range(200))

    def toxic():
        words = [word() for _ in range(rng.randint(80, 200))]
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["loweida", "vequta"]) + word())
        return " ".join(words)

    model = toxicity.Model([toxic() for _ in range(300)], [ordinary() for _ in range(1200)], 0.1)
    distance = toxicity.Distance(model.ordinary, model.toxic)
    caught, wrong = (model.score(distance.features([make().encode() for _ in range(300)])) >= 0.5 for make in (toxic, ordinary))
    assert caught.mean() >= 0.8 and wrong.mean() <= 0.02

    same = b"loweidaste vequtaver und mehr"
    many = distance.features([same, b"".join([same.ljust(30)] * 50)])
    reached = slice(toxicity.LARGEST, -1)
    assert (many[1, reached] <= many[0, reached] + np.log(3)).all()


def test_kept_rules_by_hand(spark):
    rng = random.Random(1)
    texts = ["| " * rng.randint(3, 9) + prose(rng, 9) if i % 2 else prose(rng, 12) + "." for i in range(200)] + ["", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    ensemble = quality.fit(docs, labels)
    assert ensemble.rules
    named = docs.select("doc_id", *[v.alias(k) for k, v in quality.statistics(F.col("text")).items()])
    values = {r["doc_id"]: r.asDict() for r in named.collect()}
    scores = {r["doc_id"]: r["score"] for r in quality.quality(docs, ensemble).collect()}
    for i, v in values.items():
        held = [w for path, w in ensemble.rules if all(v[name] <= at if sign == "<=" else v[name] > at for name, sign, at in path)]
        assert math.isclose(scores[i], 1 / (1 + math.exp(-(ensemble.intercept + sum(held)))), abs_tol=1e-9)
    path = ensemble.rules[0][0]
    assert named.where(condition(path)).count() == sum(all(v[n] <= a if s == "<=" else v[n] > a for n, s, a in path) for v in values.values())


def test_the_tables_are_a_convolution():
    rng = random.Random(5)
    network = language_id.Network([prose(rng, 60) + (" das" if i % 2 else " que") * 9 for i in range(40)], ["de", "es"] * 20)
    raw = prose(rng, 80).encode()
    w = language_id.windows(raw)
    got = network.log_probabilities(w, network.tables())
    places = language_id.WINDOW - max(language_id.WIDTHS) + 1
    for row, out in zip(w, got):
        peaks = []
        for width, filters in zip(language_id.WIDTHS, network.bank):
            at_each = np.array([sum(filters[k][row[p + k]] for k in range(width)) for p in range(places)])
            peaks.append(np.maximum(at_each.max(axis=0), 0))
        logits = np.concatenate(peaks) @ network.dense[:-1] + network.dense[-1]
        assert np.allclose(out, logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max(), atol=1e-3)


def test_a_letter_is_a_letter():
    assert not any(language_id.has_letter(t) for t in ("", "1 2", "½ ² ③", "_-_", "́", "٣"))
    assert all(language_id.has_letter(t) for t in ("1a", "é", "ʰ", "語", "ß"))


def test_lexical_features_decide_where_no_rule_does(spark):
    rng = random.Random(2)
    url = lambda host, bad: f"http://{host}/" + ("".join(rng.choice("0123456789") for _ in range(40)) if bad else "page")
    rows = [(f"a{i}.one", True) for i in range(60)] + [(f"b{i}.two", False) for i in range(60)]
    pages = [(i, url(h, bad)) for i, (h, bad) in enumerate(rows)] + [(1000 + i, url(f"c{i}.three", i % 2 == 0)) for i in range(40)]
    out = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), [("block", "one", "/"), ("allow", "two", "/")]).collect()}
    assert [out[1000 + i]["verdict"] for i in range(40)] == ["block", "allow"] * 20
    assert all(out[1000 + i]["rule"] is None for i in range(40))


def kept_by_hand(hashes, n_words):
    out = set()
    for at in range(n_words - decontaminate.WINDOW + 1):
        grams = hashes[at : at + decontaminate.WINDOW - decontaminate.GRAM + 1]
        out.add(at + max(i for i, h in enumerate(grams) if h == min(grams)))
    return out


def test_winnowing_keeps_the_least_of_each_window():
    rng = random.Random(9)
    for n in (3, 10, 11, 60):
        words = words_of(pa.array([" ".join(rng.choice("abcd") for _ in range(n))]))
        kept, hashes = decontaminate.winnow(words)
        grams = gram_hashes(words, decontaminate.GRAM)[0].tolist()
        assert set(kept.tolist()) == kept_by_hand(grams, n) and hashes.tolist() == [grams[k] for k in kept]


def test_hits_come_from_fingerprints(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (None, "w3 w4")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: (14, 2), 2: (0, 0)}
    for limit in (0, 1 << 20):
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(docs, bench, broadcast_bytes=limit).collect()} == {1: 14, 2: 0}
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    monkeypatch.setattr(decontaminate, "winnow", lambda words: none)
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == {1: 2, 2: 0}  # the short item alone, which has no fingerprint


def test_the_same_table_in_other_files_is_placed_the_same(spark):
    rows = [(i % 900, f"t{i % 7}", i) for i in range(2000)] + [(5, "same", 0)] * 700
    a, b = (
        sorted(tuple(r) for r in shard_ring.ring_shards(spark.createDataFrame(part, "doc_id long, text string, cell int").repartition(n)).collect())
        for part, n in ((rows, 3), (rows[::-1], 7))
    )
    assert [r[:3] + r[4:6] for r in a] == [r[:3] + r[4:6] for r in b] and len(a) == 2700


def test_movement_as_registered(spark):
    docs = spark.createDataFrame([(i, "t") for i in range(6000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["shard"] for r in shard_ring.ring_shards(docs, shards=n).collect()} for n in (24, 25))
    moved = [i for i in a if a[i] != b[i]]
    assert len(moved) < 0.12 * 6000  # 0.04 is what the new shard takes; bounded loads with no slack move some more


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.9) < jaccard_join.runs_for(0.9999) == jaccard_join.RUNS == 9


def test_buckets_are_split_level_by_level(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {tuple(r) for r in jaccard_join.jaccard_join(docs).collect()}
    assert {tuple(r) for r in jaccard_join.jaccard_join(docs, limit=4).collect()} == plain
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for _, t in rows]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    assert [r[2] for r in sorted(plain)] == links
