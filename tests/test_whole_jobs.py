"""Queries that do a survey row's whole job, against brute force on small tables."""

import re

import pytest

from heddle.operators import documents, graphs, ledger, scripts

def graph_tables(spark, folder, cells, edges):
    """``cells`` (key, size) as parts; ``edges`` (source, target, discount, quantity) as orders of two lines."""
    spark.createDataFrame([(k, size, "b", f"n{k}", "t") for k, size in cells], "p_partkey long, p_size int, p_brand string, p_name string, p_type string").write.parquet(f"{folder}/part.parquet")
    lines = [(o, n, part, 1, d, q) for o, (a, b, d, q) in enumerate(edges) for n, part in ((1, a), (2, b))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_selected_cells_reach_25_hops(spark, tmp_path):
    # p_size 48 and 24: tier 1, 56: tier 3; all are prerequisites of what follows them
    chain = [(100 + i, 48 if i == 40 else 56) for i in range(41)]
    other = [(1, 56), (2, 24), (3, 56), (4, 48)]
    steps = [(100 + i, 101 + i) for i in range(40)] + [(1, 2), (1, 4), (3, 1), (1, 3)]
    folder = graph_tables(spark, tmp_path, chain + other, [(a, b, 0.1, 1.0) for a, b in steps])
    got = {r["cell"]: (r["hop"], r["origin"]) for r in graphs.g01_selected_cells(spark, folder).collect()}
    expected = {cell: (0, cell) for cell, size in chain + other if 1 + size % 3 <= 2}
    level, hop = dict(expected), 0
    while level and hop < 25:
        hop += 1
        found = {}
        for a, b in steps:
            if b in level and a not in expected:
                found[a] = (hop, min(level[b][1], found.get(a, (0, level[b][1]))[1]))
        expected |= found
        level = found
    assert got == expected
    assert got[115] == (25, 140) and 114 not in got and got[1] == (1, 2) and got[3] == (2, 2)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


ITEMS = ["Ünï café one", "Uni cafe one", "متن دوم ساده است", "جمله دیگر ساده نبود", "one two  three", "three two one 😀", None, "الف"]


def test_text_metrics(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["distance"], r["error_rate"], r["word_distance"], r["word_error_rate"], r["exact"]) for r in documents.q29_text_metrics(spark, str(tmp_path)).collect()}
    texts = [" ".join((t or "").split()) for t in ITEMS]
    for i, (t, u) in enumerate(zip(texts, texts[1:])):
        d, w = distance(t, u), distance(t.split(), u.split())
        assert got[i] == (d, d / max(len(t), 1), w, w / max(len(t.split()), 1), t == u)
    assert len(got) == len(ITEMS) - 1 and got[0][0] > 0 and not got[2][4]


def sound(text):
    return re.sub(r"\W+", " ", text.lower()).strip()


def cut(a, b):
    e, f = " ".join(a.split()[-6:]), " ".join(b.split()[-10:])
    return bool(e) and 1 - distance(e, f) / max(len(e), len(f), 1) < 0.55


LONG = " ".join(f"word{i}" for i in range(30))
SAID = ["یک دو سه چهار پنج شش هفت", "هشت نه ده بیست سی چهل", "یک دو سه چهار پنج شش هفت", LONG, LONG + " and quite another ending of the same turn", LONG, "", "Привет, мир!", "привет мир", LONG + " " + LONG, LONG + " " + LONG]


def turn_tables(spark, folder):
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(SAID)], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return [(sound(a), sound(b)) for a, b in zip(SAID, SAID[1:])]


def test_cut_tails(spark, tmp_path):
    pairs = turn_tables(spark, tmp_path)
    got = {r["position"]: r["cut"] for r in scripts.t36_cut_tails(spark, str(tmp_path)).collect()}
    assert got == {i: cut(a, b) for i, (a, b) in enumerate(pairs)} and got[0] and not got[7]


def test_tier_verdicts(spark):
    arms = lambda project, base, other, cost: [(project, "A", s, 100, 1) for s in base] + [(project, "R", s, cost, 1) for s in other]
    ok, bad = "succeeded", "failed"
    rows = arms("switch", [bad, ok, bad, ok], [ok] * 4, 120) + arms("dear", [bad, ok], [ok, ok], 121) + arms("small", [bad] + [ok] * 9, [ok] * 10, 100)
    rows += arms("unpriced", [bad, ok], [ok, ok], 100) + [("unpriced", "R", ok, None, 5)] + arms("one arm", [bad], [], 100)
    calls = spark.createDataFrame(rows, "project_id string, stage string, status string, cost_micros long, input_tokens long")
    got = {r["project_id"]: r["verdict"] for r in ledger.tier_verdicts(calls).collect()}
    assert got == {"switch": "switch", "dear": "keep", "small": "keep", "unpriced": "undecidable", "one arm": "undecidable"}



def test_components_of_a_long_path(spark):
    from heddle.operators.structure import components

    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 100)] + [(200, 300)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert roots == {i: 0 for i in (*range(41), 100, 101)} | {200: 200, 300: 200}


def test_masks_cover_each_kind(spark):
    from pyspark.sql import functions as F

    from heddle.operators.reviews import masked, sensitive

    text = "AIza" + "b" * 30 + " sk-" + "c" * 25 + " 09123456789 +989123456789 00989123456789 C:\\Users\\me\\x /home/me/y"
    row = spark.createDataFrame([(text,)], "t string").select(masked(F.col("t")).alias("m")).first()["m"]
    assert row == "[REDACTED_GEMINI_KEY] [REDACTED_SECRET] [REDACTED_PHONE] [REDACTED_PHONE] [REDACTED_PHONE] [HOME]\\x [HOME]/y"
    names = spark.createDataFrame([("Api-Key",), ("colour",), ("X-Auth-TOKEN",)], "n string").select(sensitive(F.col("n")).alias("s"))
    assert [r["s"] for r in names.collect()] == [True, False, True]


def test_blocks_keep_digits_that_are_their_place(spark, tmp_path):
    from heddle.sources.views import blocks

    text = "0 call 555-8630\n 1 of 171 \n\n2\n 33 \n"
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["idx"], r["text"]) for r in blocks(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [(0, "0 call 555-8630"), (1, "1 of 171"), (2, "2"), (3, "33")]


def test_sentences_keep_digits_that_are_their_place(spark, tmp_path):
    text = "0 is first. Then 11! 2 " + "x" * 290 + ". 3"
    spark.createDataFrame([(1, 0, "user", text)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r["sentences"], r["chunks"]) for r in scripts.t31_segments(spark, str(tmp_path)).collect()] == [(4, 2)]


def test_similar_labels_are_paired_in_parts_and_counted_by_set(spark, tmp_path, monkeypatch):
    from heddle.operators import structure

    six = "a b c d e f"
    labels = [six] * 9 + [six + " g"] * 4 + ["x y"] * 5 + ["x"] * 2 + [""]
    cells = [(k, None if k % 4 == 3 else f"b{k % 3}", label) for k, label in enumerate(labels)]
    spark.createDataFrame([(k, 1, chapter, label, "t") for k, chapter, label in cells], "p_partkey long, p_size int, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    sets = {k: set(label.split()) for k, _, label in cells}
    alike = [(a, b) for a, ca, _ in cells for b, cb, _ in cells if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    monkeypatch.setattr(structure, "CELLS_IN_PART", 2)
    assert sorted((r["a"], r["b"]) for r in structure.g14_label_similarity(spark, str(tmp_path)).collect()) == alike
    chapters, expected = {k: c for k, c, _ in cells}, {}
    for a, b in alike:
        ca, cb = chapters[a], chapters[b]
        key = (min((c for c in (ca, cb) if c), default=None), "merged" if ca is not None and ca == cb else "flagged")
        expected[key] = expected.get(key, 0) + 1
    monkeypatch.setattr(structure, "label_pairs", None)  # the pairs themselves aren't made for their number
    assert {(r["chapter"], r["kind"]): r["pairs"] for r in structure.g29_normalised_cells(spark, str(tmp_path)).collect()} == expected


def test_pairs_of_labels_are_dealt_to_all_tasks(spark, tmp_path):
    from heddle.operators import structure

    six = "a b c d e f"
    cells = [(k, six) for k in range(9)] + [(k, six + " g") for k in range(6, 12)] + [(None, six)]  # some cells twice, with like labels
    spark.createDataFrame([(k, 1, "b", label, "t") for k, label in cells], "p_partkey long, p_size int, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    pairs = structure.g14_label_similarity(spark, str(tmp_path))
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b) for a, _ in cells for b, _ in cells if a is not None and b is not None and a < b)
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # the lists are small, what they make isn't


def test_only_lines_with_likes_are_compared(spark, tmp_path):
    near = "one two three four five six seven eight nine ten"
    docs = [(1, f"{near}\nquite another line of many words here\n{near} eleven\n{near}"), (2, "no line is like the other here\nand this one is all on its own"), (3, f"{near}\nalone"), (3, f"x\nsolitary words only\n{near} more")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = sorted((r["doc_id"], r["idx"]) for r in scripts.lines_with_likes(frame, 0.6).collect())
    assert kept == [(1, 0), (1, 2), (1, 3), (3, 0), (3, 0), (3, 1), (3, 1), (3, 2)]
    got = sorted((r["doc_id"], r["position"], r["later"], round(r["similarity"], 6)) for r in scripts.t03_near_repeats(spark, str(tmp_path)).collect())
    assert got == [(1, 0, 0, 1.0), (1, 0, 2, round(8 / 9, 6)), (3, 0, 2, round(8 / 9, 6))]


BLOCK_QUERIES = ["b09_packed_blocks", "b11_merged_neighbours", "b13_block_ids", "b14_locators", "b15_block_identity", "b17_identity_texts"]
BLOCK_QUERIES += ["b18_content_keys", "b19_equal_documents", "b20_sequence_keys", "b21_partition_keys", "b25_chapter_keys", "b27_heading_runs"]


def test_blocks_of_odd_characters_agree_with_sql(spark, tmp_path):
    """Spaces, line ends, capitals and word borders that Java and SQL take differently, one in each document."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    odd = [*range(1, 48), *range(0x7F, 0xC0), 0x130, 0x131, 0x17F, 0x1E9E, 0x3A3, 0x3C2, 0x61C, 0x1680, 0x180E, *range(0x2000, 0x2030), 0x205F, 0x2060, 0x2126, 0x212A, 0x212B, 0x3000, 0xFB01, 0xFEFF, 0xFFFD, 0x1F600, 0x1D7D8]
    rows = []
    for i, x in enumerate(map(chr, odd)):
        lines = [f"{x}Heading {i}{x}", f"Ends.{x}", x, f"ALL{x} ISBN{x} ΟΔΟΣ{x}text that goes on. " * 3, f"{x}| a\t{x}b\t", f"$a{x}b$", f"\\int{x} y", f"x;{x}", f"Licen{x}ed under", f"TABLE{x} 1", f"two  {x}words{x}{x}", f"1. {x}", f"- {x}", f"``{x}`", "Last.\r"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql, con = entry.oracle_sql(), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in BLOCK_QUERIES:
        out = entry.queries()[name](spark, str(tmp_path))
        got, want = sorted(map(repr, map(tuple, out.collect()))), sorted(map(repr, con.execute(sql[name]).fetchall()))
        assert got == want, (name, [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])


def test_arabic_marks_are_folded_as_in_sql(spark, tmp_path):
    """All between the first and the last mark go, signs and dotless letters among them, and nothing beside them."""
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    rows = [(x, f"{chr(x)}\nab{chr(x)}c {chr(x)}\n{chr(x)}z", "en", "s") for x in range(0x600, 0x700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sql, con = entry.oracle_sql(), duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("b17_identity_texts", "b19_equal_documents"):
        got, want = sorted(map(repr, map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()))), sorted(map(repr, con.execute(sql[name]).fetchall()))
        assert got == want, (name, [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
