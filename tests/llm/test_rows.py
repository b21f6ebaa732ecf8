"""Stages decide by row: repeated and null ids."""

from heddle.llm import decontaminate, exact_dedup, jaccard_join

DDL = "doc_id long, text string, source string"
A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
NEAR_A, NEAR_B = A + " end", B + " end"


def kept(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)


def test_only_contaminated_rows_go(spark):
    rows = [(None, A), (None, B), (None, None), (None, "x"), (5, B), (5, A), (5, "y"), (6, NEAR_A), (6, NEAR_A), (7, B), (7, B)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DDL).repartition(3)
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, A)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert kept(left) == sorted([r for r in rows if not (r[1] or "").startswith("a0")], key=str)


def test_one_row_of_each_class_stays(spark):
    rows = [(5, A), (5, B), (3, NEAR_B), (8, NEAR_A), (9, "other words"), (9, None), (None, "alone"), (None, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DDL).repartition(3)
    assert kept(jaccard_join.keep_one_of_each(docs)) == sorted([r for r in rows if r not in [(5, B), (8, NEAR_A)]], key=str)


def test_near_copies_under_one_id_or_none(spark):
    rows = [(4, A), (4, NEAR_A), (6, B), (6, B), (7, NEAR_B), (None, "q " + A), (None, "r " + A), (None, ""), (None, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], DDL).repartition(3)
    left = kept(jaccard_join.keep_one_of_each(docs))
    assert len(left) == 5 and [d for d, _ in left].count(4) == 1 and [t for d, t in left if d == 6] == [B] and len([t for _, t in left if t and t[1:] == " " + A]) == 1


CLASHING = ["_at", "_Slot", "_word", "_sha", "_id", "_key", "_text_sha", "_b", "kept", "text_sha256", "salt", "a.b", "n"]


def test_columns_of_any_name_come_back_as_they_are(spark):
    texts = [(1, A), (2, A), (3, NEAR_A), (4, B), (5, "alone " + B), (6, None), (None, A)]
    rows = [(d, t, *(f"{c}{k}" for c in CLASHING)) for k, (d, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    benchmark = spark.createDataFrame([(1, B)], "item_id long, text string")
    stages = [(exact_dedup.keep_first_copies, 5), (jaccard_join.keep_one_of_each, 4), (lambda d: decontaminate.drop_contaminated(d, benchmark), 5)]
    for stage, n in stages:
        left = stage(docs)
        assert left.columns == docs.columns
        got = [tuple(r) for r in left.collect()]
        assert len(got) == n and set(got) <= set(rows)
