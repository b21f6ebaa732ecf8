"""Texts found in other texts: sentences of one in the words of another, each span taken once, and excerpts found on folded
text but given back as they stand in the original.

``SQL`` holds the same rules for DuckDB, whose edit distance counts bytes: the characters of the texts compared are first
numbered, which 127 different ones allow.  For sentences in windows it compares every window with every sentence and takes
minutes on the smallest table, so that these queries are tested against brute force instead."""

from __future__ import annotations

import sys
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import ARABIC_FROM, ARABIC_TO, MARKS_FROM, MARKS_TO, edit_similarity, fold_for_sound
from heddle.operators.scripts import cut_tail, in_order
from heddle.sources.views import evidence, turns

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so that executors need no copy of this package

SCALES = (0.8, 1.0, 1.2)  # widths of windows, in parts of a sentence's words
FOUND = 0.85
GRAM = 3  # characters of the runs by which windows are told apart before they are compared
PASSES, REVIEW = 0.9, 0.78


def sentences(text: Column) -> Column:
    """Folded sentences of at least four words."""
    cut = F.split(text, r"(?<=[.!?؟؛])\s+")
    long = F.filter(cut, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4)
    return F.transform(long, fold_for_sound)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def windows_near(said: list[str], words: list[str], least: Fraction) -> list[tuple[int, int, int]]:
    """(sentence, first word, word behind) of all windows that may be as similar as ``least`` to a sentence.

    Windows whose length alone asks for too many edits go.  An edit spoils at most ``GRAM`` of a sentence's runs of characters: the others are in the window, at
    their place give or take the edits, and windows that hold fewer go.  None that is similar enough is left out."""
    text = " ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = ends - np.array([len(word) for word in words])
    at: dict[str, list[int]] = {}
    out = []
    for no, sentence in enumerate(said):
        n, size = len(sentence.split()), len(sentence)
        if not n:
            continue
        if len(words) <= n:
            out.append((no, 0, len(words)))
            continue
        if not at:
            for k in range(len(text) - GRAM + 1):
                at.setdefault(text[k : k + GRAM], []).append(k)
        edits = int((1 - least) / least * size)
        found = [(k, at[sentence[k : k + GRAM]]) for k in range(size - GRAM + 1) if sentence[k : k + GRAM] in at]
        if len(found) < size - GRAM + 1 - GRAM * edits:
            continue
        runs = np.repeat([k for k, _ in found], [len(places) for _, places in found]).astype(np.int64)
        begin = np.array([p for _, places in found for p in places], np.int64) - runs
        low, high = begin - edits, begin + edits + 1
        same = runs[1:] == runs[:-1]
        low[1:][same] = np.maximum(low[1:][same], high[:-1][same])  # a run counts once for a beginning
        low, high = (np.clip(x, 0, len(text)) for x in (low, high))
        held = np.cumsum(np.bincount(low, minlength=len(text) + 1) - np.bincount(high, minlength=len(text) + 1))
        for width in sorted({max(1, round(n * scale)) for scale in SCALES}):
            first = starts[: max(0, len(words) - width + 1)]
            length = ends[width - 1 :][: len(first)] - first
            most = np.maximum(length, size) * (least.denominator - least.numerator) // least.denominator
            near = (abs(length - size) <= most) & (held[first] >= size - GRAM + 1 - GRAM * most)
            out += [(no, i, i + width) for i in np.flatnonzero(near).tolist()]
    return out


def _windows():
    def body(said: pd.Series, words: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([[{"no": a, "start": b, "stop": c} for a, b, c in windows_near(list(s), list(w), Fraction(t).limit_denominator(10000))] for s, w, t in zip(said, words, least)])

    body.__annotations__ = {"said": pd.Series, "words": pd.Series, "least": pd.Series, "return": pd.Series}
    return F.pandas_udf(body, "array<struct<no: int, start: int, stop: int>>")


def placed_sentences(pairs: DataFrame, least: float = FOUND) -> DataFrame:
    """``pairs`` (said: folded sentences, w: words of the other text, any others) with ``taken``: (no, start, stop, score) of the
    sentences found, in order.  A sentence takes its best window among those that no earlier one has taken a word of."""
    score = lambda c: edit_similarity(F.get("said", c["no"]), F.array_join(F.slice("w", c["start"] + 1, c["stop"] - c["start"]), " "))
    near = pairs.withColumn("near", _windows()("said", "w", F.lit(float(least))))
    scored = F.transform("near", lambda c: F.struct(c["no"].alias("no"), (-score(c)).alias("low"), (c["stop"] - c["start"]).alias("width"), c["start"].alias("start"), c["stop"].alias("stop")))
    kept = near.withColumn("kept", F.array_sort(F.filter(scored, lambda c: c["low"] <= -least)))
    free = lambda taken, c: ~F.exists(taken, lambda t: (t["no"] == c["no"]) | ((t["start"] < c["stop"]) & (c["start"] < t["stop"])))
    one = lambda c: F.struct(c["no"].alias("no"), c["start"].alias("start"), c["stop"].alias("stop"), (-c["low"]).alias("score"))
    none = F.array().cast("array<struct<no: int, start: int, stop: int, score: double>>")
    return kept.withColumn("taken", F.aggregate("kept", none, lambda taken, c: F.when(free(taken, c), F.concat(taken, F.array(one(c)))).otherwise(taken))).drop("near", "kept")


def spoken_pairs(spark, sf_dir) -> DataFrame:
    """Each turn with the next one of its segment: folded texts a and b, their words v and w, and the turn's sentences."""
    t = turns(spark, sf_dir).select("segment_id", "position", "text", fold_for_sound(F.col("text")).alias("a"))
    t = t.withColumn("b", F.lead("a").over(in_order())).where("b is not null")
    return t.select("segment_id", "position", "a", "b", _words(F.col("a")).alias("v"), _words(F.col("b")).alias("w"), sentences(F.col("text")).alias("said"))


def t44_sentence_windows(spark, sf_dir):
    """Each sentence of a turn with the span of words of the next turn that it takes, if any."""
    placed = placed_sentences(spoken_pairs(spark, sf_dir))
    each = placed.select("segment_id", "position", "taken", F.posexplode("said").alias("sentence", "text"))
    hit = F.get(F.filter("taken", lambda t: t["no"] == F.col("sentence")), F.lit(0))
    each = each.select("segment_id", "position", "sentence", hit.alias("hit"))
    return each.select("segment_id", "position", "sentence", F.col("hit.start").alias("first_word"), (F.col("hit.stop") - F.col("hit.start")).alias("words"), F.col("hit.score").alias("score"))


def t34_missing_sentences(spark, sf_dir):
    """How many sentences each turn has and which of them the next turn misses."""
    placed = placed_sentences(spoken_pairs(spark, sf_dir))
    left = F.filter(F.transform("said", lambda s, i: F.when(~F.exists("taken", lambda t: t["no"] == i), s)), lambda s: s.isNotNull())
    return placed.select("segment_id", "position", F.size("said").alias("sentences"), F.size(left).alias("missing"), F.md5(F.array_join(left, "\n").cast("binary")).alias("missing_md5"))


def t33_text_verdicts(spark, sf_dir, passes: float = PASSES, review: float = REVIEW):
    """Each turn against the next, whole texts: edit similarity, missing sentences (T34), phrases of six words that the next one
    repeats (T35), a tail that it cuts (T36), and the verdict."""
    similar = F.when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(edit_similarity(F.col("a"), F.col("b")))
    grams = F.when(F.size("w") >= 12, F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))).otherwise(F.array().cast("array<string>"))
    t = placed_sentences(spoken_pairs(spark, sf_dir))
    t = t.withColumns({"similarity": similar, "missing": F.size("said") - F.size("taken"), "grams": grams, "truncated": cut_tail(F.col("v"), F.col("w"))})
    t = t.withColumn("repeated", F.size("grams") > F.size(F.array_distinct("grams")))
    fine = (F.col("similarity") >= passes) & (F.col("missing") == 0) & ~F.col("repeated") & ~F.col("truncated")
    verdict = F.when(fine, "pass").when((F.col("similarity") >= review) & ~F.col("truncated"), "manual_review").otherwise("regenerate")
    return t.select("segment_id", "position", "similarity", "missing", "repeated", "truncated", verdict.alias("verdict"))


# Excerpts

#: Characters that are dropped before an excerpt is looked for.
DROPPED = "[­​-‏﻿⁠ـً-ْٰ]"


def fold_character(c: Column) -> Column:
    """One character folded: none, one, or more than one."""
    plain = F.translate(F.translate(c, ARABIC_FROM, ARABIC_TO), MARKS_FROM, MARKS_TO)
    plain = F.replace(F.replace(F.lower(plain), F.lit("…"), F.lit("...")), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.regexp_replace(plain, DROPPED, ""), r"[ \t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{2028}\x{2029}]", " ")


def with_fold_map(rows: DataFrame, text: str, folded: str, places: str) -> DataFrame:
    """``rows`` with a text folded character by character, spaces collapsed, and for each folded character the place (from 1) of
    the original one that it comes from."""
    rows = rows.withColumn("_c", F.split(F.coalesce(text, F.lit("")), ""))
    each = F.transform("_c", lambda c, i: F.transform(F.filter(F.split(fold_character(c), ""), lambda x: x != ""), lambda x: F.struct(x.alias("x"), (i + 1).alias("at"))))
    rows = rows.withColumn("_f", F.flatten(each))
    blank = F.struct(F.lit(" ").alias("x"), F.lit(0).alias("at"))
    rows = rows.withColumn("_f", F.filter(F.zip_with("_f", F.slice(F.concat(F.array(blank), "_f"), 1, F.size("_f")), lambda x, before: F.when((x["x"] != " ") | (before["x"] != " "), x)), lambda x: x.isNotNull()))
    return rows.withColumns({folded: F.array_join(F.transform("_f", lambda x: x["x"]), ""), places: F.transform("_f", lambda x: x["at"])}).drop("_c", "_f")


def located(rows: DataFrame, excerpt: str, text: str) -> DataFrame:
    """``rows`` with start and end (offsets in the original text, end exclusive) of the first place whose folding is the excerpt's; null
    where there is none or the excerpt folds to nothing."""
    rows = with_fold_map(with_fold_map(rows, excerpt, "_needle", "_n"), text, "_hay", "_at")
    rows = rows.withColumn("_needle", F.rtrim("_needle")).withColumn("_p", F.when(F.col("_needle") != "", F.nullif(F.expr("locate(_needle, _hay)"), F.lit(0))))
    return rows.withColumns({"start": F.get("_at", F.col("_p") - 1) - 1, "end": F.get("_at", F.col("_p") + F.length("_needle") - 2)}).drop("_needle", "_n", "_hay", "_at", "_p")


def e01_folded_texts(spark, sf_dir):
    """Each document's longest excerpt folded with its map: how many characters it folds to, and where the middle one comes from."""
    e = evidence(spark, sf_dir).groupBy("doc_id").agg(F.max(F.struct(F.length("excerpt").alias("n"), "excerpt")).alias("m")).select("doc_id", F.col("m.excerpt").alias("excerpt"))
    f = with_fold_map(e, "excerpt", "folded", "places")
    return f.select("doc_id", F.md5(F.col("folded").cast("binary")).alias("folded_md5"), F.size("places").alias("characters"), F.get("places", F.floor(F.size("places") / 2).cast("int")).alias("middle"))


def e03_original_spans(spark, sf_dir):
    """Excerpts of evidence, changed in case, quotes and spaces, and the original text of the span where they are found."""
    changed = F.regexp_replace(F.upper("excerpt"), " ", "  ")
    e = located(evidence(spark, sf_dir).select("doc_id", "idx", "text", changed.alias("excerpt")), "excerpt", "text")
    return e.select("doc_id", "idx", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.substr(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("binary")).alias("span_md5"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] in "et" and name[1:3].isdigit()}


def _sql() -> dict[str, str]:
    from heddle.plans.document_sql import fold

    sound = lambda x: rf"trim(regexp_replace({fold(x)}, '[^\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200C}}\x{{200D}}]+', ' ', 'g'))"
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda u: u <> '')"
    coded = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda u: chr(list_position(known, u)::INT)), '')"
    similar = lambda x, y: f"(1 - levenshtein({coded(x)}, {coded(y)}) / greatest(length({x}), length({y}), 1)::DOUBLE)"
    pairs = rf"""f AS (SELECT segment_id, position, text, {sound("text")} AS a FROM turns), g AS (SELECT *, lead(a) OVER (PARTITION BY segment_id ORDER BY position) AS b FROM f),
        p AS (SELECT segment_id, position, a, b, {words("a")} AS v, {words("b")} AS w, list_distinct(string_split(a || ' ' || b, '')) AS known,
            list_transform(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?؟؛])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\s+'), lambda u: u <> '')) >= 4), lambda s: {sound("s")}) AS said FROM g WHERE b IS NOT NULL)"""
    cut = f"""(len(v) > 0 AND {similar("array_to_string(v[-6:], ' ')", "array_to_string(w[-10:], ' ')")} < 0.55)"""
    marks = MARKS_FROM.replace("'", "''"), MARKS_TO.replace("'", "''")
    one = lambda c: rf"regexp_replace(regexp_replace(replace(replace(lower(translate(translate({c}, '{ARABIC_FROM}', '{ARABIC_TO}'), '{marks[0]}', '{marks[1]}')), '…', '...'), 'ß', 'ss'), '{DROPPED}', '', 'g'), '[ \t\n\x0B\f\r\x1C-\x1F\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}]', ' ', 'g')"
    flat = lambda x: f"flatten(list_transform(range(length({x})), lambda i: list_transform(list_filter(string_split({one(f'{x}[i + 1]')}, ''), lambda u: u <> ''), lambda u: {{'x': u, 'pos': i + 1}})))"
    squeezed = lambda x: f"list_filter({x}, lambda u, i: u.x <> ' ' OR (i > 1 AND {x}[i - 1].x <> ' '))"
    text_of = lambda x: f"array_to_string(list_transform({x}, lambda u: u.x), '')"
    return {
        "t36_cut_tails": f"WITH {pairs} SELECT segment_id, position, {cut} AS cut FROM p",
        "e01_folded_texts": f"""WITH e AS (SELECT doc_id, max({{'n': length(excerpt), 'excerpt': excerpt}}).excerpt AS excerpt FROM evidence GROUP BY 1), f AS (SELECT doc_id, {flat("excerpt")} AS f FROM e), q AS (SELECT doc_id, {squeezed("f")} AS f FROM f)
            SELECT doc_id, md5({text_of("f")}) AS folded_md5, len(f)::INT AS characters, f[len(f) // 2 + 1].pos::INT AS middle FROM q""",
        "e03_original_spans": f"""WITH e AS (SELECT doc_id, idx, text, regexp_replace(upper(excerpt), ' ', '  ', 'g') AS excerpt FROM evidence), f AS (SELECT *, {flat("text")} AS h, {flat("excerpt")} AS n FROM e),
            q AS (SELECT doc_id, idx, text, {squeezed("h")} AS h, rtrim({text_of(squeezed("n"))}) AS needle FROM f), r AS (SELECT *, CASE WHEN needle <> '' THEN nullif(strpos({text_of("h")}, needle), 0) END AS pos FROM q),
            x AS (SELECT doc_id, idx, text, (h[pos].pos - 1)::BIGINT AS a, h[pos + length(needle) - 1].pos::BIGINT AS b FROM r)
            SELECT doc_id, idx, a AS start, b AS "end", md5(substring(text, a + 1, b - a)) AS span_md5 FROM x""",
    }


SQL = _sql()
