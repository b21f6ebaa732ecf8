"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from heddle.llm import decontaminate, exact_dedup, language_id, license_scan, quality, toxicity

DDL = "doc_id long, text string, lang string, source string, n_chars long, uid long, rep long, kept boolean, score double"
TAIL = ("en", "s", 1, 5, 6, True, 0.5)
TEXTS = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a  b", "ab", "É x", "Éx", "x" * 70000, " " + "x" * 70000, "a" * 300 + "b", "a" * 300 + "c", "ab ", "\x00", "😀"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *TAIL) for r in rows], DDL).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DDL)


def dedup_by_hand(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    return groups


@pytest.mark.parametrize("budget", [96 << 20, 500])
def test_exact_dedup(spark, budget):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(3, "a b"), (None, "a b"), (None, "only null"), (None, "only null")]
    out = [r.asDict() for r in exact_dedup.exact_dedup(frame(spark, rows), trie_bytes=budget).collect()]
    groups = dedup_by_hand(rows)
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        members = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(members) and r["keep_id"] == min(members)[3]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_keep_first_copies(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(3, "a b"), (3, "other"), (None, "only null"), (None, "only null")]
    left = exact_dedup.keep_first_copies(frame(spark, rows))
    assert left.columns == [c.split()[0] for c in DDL.split(", ")]
    got = sorted(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in left.collect())
    assert got == sorted(dedup_by_hand(rows))
    assert exact_dedup.keep_first_copies(empty(spark)).count() == 0


def test_trie_splits_labels():
    trie = exact_dedup.Trie()
    keys = [bytes([65 + i % 3, 66, 67 + i % 5, 68]) for i in range(30)]
    for k in keys:
        trie.terminal(k).append(1)
    assert {k: len(v) for k, v in trie.walk()} == {k: keys.count(k) for k in set(keys)}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks_by_hand(doc, items):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        v = words(text)
        n = min(10, len(v))
        for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add(item)
    ids = ",".join(sorted(str(i) for i in found if i is not None))
    return len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest()


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_decontaminate(spark, limit):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(40)] + ["Über", "naïve"]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([25, 12, 10, 10, 9, 2, 1, 40])] + [(20, None), (21, " . "), (None, " ".join(rng.choice(vocabulary, 15))), (3, "w1 w2 w3")]
    docs = [None, "", "..", "w1"] + [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(40)]
    for i, text in items[:8]:
        docs += [f"intro {text.upper()} tail", " ".join(rng.choice(vocabulary, 12)) + " " + text, text + " " + text]
    docs.append(" ".join(rng.choice(vocabulary, 4000)) + " " + items[0][1])
    rows = list(enumerate(docs)) + [(None, items[0][1]), (2, items[1][1]), (2, items[1][1])]
    out = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()
    expected = sorted([(d, *leaks_by_hand(t, items)) for d, t in rows], key=str)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out], key=str) == expected
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out)


def test_decontaminate_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.decontaminate(frame(spark, [(1, "a b c")]), none).collect()] == [0]
    assert decontaminate.decontaminate(empty(spark), none).count() == 0
    kept = decontaminate.drop_contaminated(frame(spark, [(1, "a b c"), (None, "d"), (2, "x y z")]), spark.createDataFrame([(1, "x y z")], "item_id long, text string"))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, None]


def labelled(spark, n=900):
    rng = np.random.default_rng(1)
    ordinary = ["".join(rng.choice(list("aeioubcdfglmnrst"), rng.integers(2, 9))) for _ in range(400)]
    bad = ["gruntlesnort", "wumpledorf", "blatherskite"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(ordinary, rng.integers(20, 80)))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(len(w))] = rng.choice(bad)
        good = i % 3 != 0
        text = " ".join(w) if good else " ".join(x + "###" for x in w)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return frame(spark, rows + [(5000, None), (5001, ""), (None, "gruntlesnort " * 3), (5002, "y" * 90000), (7, "repeated")]), spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def accuracy(out, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect() if r[name] is not None}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity(spark):
    docs, labels = labelled(spark)
    out = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert accuracy(out, labels, "toxic") > 0.95
    model = toxicity.fit(docs, labels)
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert {5000, 5001, 5002} <= kept


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 40)
    none = labels.where("false")
    ones = labels.where("toxic = 1").withColumn("quality", labels["toxic"])
    assert {r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(docs, toxicity.fit(docs, ones)).collect()} == {1.0}
    assert {r["score"] for r in quality.quality(docs, quality.fit(docs, none)).collect()} == {0.0}
    assert {r["score"] for r in quality.quality(docs, quality.fit(docs, ones)).collect()} == {1.0}
    assert toxicity.toxicity(empty(spark), toxicity.fit(empty(spark), none)).count() == 0
    assert quality.quality(empty(spark), quality.fit(empty(spark), none)).count() == 0


def test_quality(spark):
    docs, labels = labelled(spark)
    ensemble = quality.fit(docs, labels)
    out = quality.quality(docs, ensemble).collect()
    assert len(out) == 905 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert accuracy(out, labels, "quality") > 0.97 and 0 < len(ensemble.rules) < 60


def test_language(spark):
    rng = np.random.default_rng(4)
    tongues = {"aa": "abcdeé", "bb": "bxyzkq", "cc": "ßöüwnt"}
    rows = []
    for i in range(600):
        lang = list(tongues)[i % 3]
        text = " ".join("".join(rng.choice(list(tongues[lang]), rng.integers(3, 9))) for _ in range(rng.integers(5, 90)))
        rows.append((i, text, lang))
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (None, rows[0][1], "aa"), (0, rows[0][1], "aa"), (903, rows[1][1] * 300, None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, score long")
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    truth = {d: lang for d, _, lang in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and by[900]["lang_pred"] == by[901]["lang_pred"] == by[902]["lang_pred"] == "und" and by[903]["lang_pred"] == "bb"
    none = docs.where("false")
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(docs.where("lang = 'aa'"))).collect()} == {"aa", "und"}
    assert language_id.identify(none, language_id.fit(docs)).count() == 0


def licences_by_hand(text, templates):
    grams = lambda w: {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
    low = lambda t: WORD.findall((t or "").lower())
    have = grams(low(text))
    return {name for name, t in templates if grams(low(t)) and len(grams(low(t)) & have) >= 0.8 * len(grams(low(t)))}


@pytest.mark.parametrize("literals", [20_000, -1])
def test_licences(spark, monkeypatch, literals):
    monkeypatch.setattr(license_scan, "LITERAL_VALUES", literals)
    rng = np.random.default_rng(3)
    filler = lambda n: " ".join(rng.choice([f"f{i}" for i in range(50)], n))
    texts = [None, "", "..", "mit", "Released under the MIT License."]
    for _, t in license_scan.TEMPLATES:
        texts += [t, filler(rng.integers(1, 90)) + " " + t.upper() + " " + filler(40), filler(20) + t[: len(t) // 2], t + " " + t]
    texts.append(filler(9000) + " Licensed under CC BY-NC 4.0. " + filler(9000))
    rows = list(enumerate(texts)) + [(4, texts[4]), (None, texts[4])]
    out = license_scan.license_scan(frame(spark, rows), license_scan.template_table(spark)).collect()
    expected = sorted([(d, name) for d, t in rows for name in licences_by_hand(t, license_scan.TEMPLATES)], key=str)
    assert sorted([(r["doc_id"], r["license_id"]) for r in out], key=str) == expected
    assert license_scan.license_scan(empty(spark), license_scan.template_table(spark)).count() == 0
    assert license_scan.license_scan(frame(spark, rows), license_scan.template_table(spark).where("false")).count() == 0


def test_pipeline_stages_keep_columns(spark, tmp_path):
    docs, labels = labelled(spark, 200)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), 205
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        count = now.count()
        assert 0 < count <= left
        left = count
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert out[["sequence_id", "offset"]].drop_duplicates().shape[0] == len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048
