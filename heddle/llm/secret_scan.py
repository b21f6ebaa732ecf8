"""Secrets in texts: fixed patterns, and candidates whose sliding windows have a high Shannon entropy.

Everything is a column expression.

1. One pass tells texts in which no pattern and no candidate occurs; their rows are done and are never shuffled.
2. Of the others each kind's matches and the pieces between them give lengths; their running sums are the spans, in
   code points.  Only these small rows are shuffled, by row.
3. A candidate is a run of at least 16 characters of an encoding's alphabet.  Its character class (``CLASSES``) has a
   window and a threshold.  As the window slides by a character, one count rises and one falls, and the sum of
   c log c, in millionths, changes by these two; windows under the limit are high in entropy.  The span
   reaches from the first such window to the end of the last.
4. Candidates that the allow-list (``ALLOWED``) knows - identifiers, dates, slugs, paths, alphabets, examples - and spans that
   overlap one of a pattern are not added.

Defined results: a null text is empty and has no spans; rows with equal or null doc_id are rows of their own; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: What each kind matches; a match of the first counts if its second group has 6 characters.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
PATTERNS = (ASSIGN, ACCESS, HEX, CANDIDATE)
VALUE = 6

#: The characters of candidates; a character's code is its place, from 1.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

#: (what the whole candidate matches, window, bits of entropy that a window needs), the first that fits: hexadecimal
#: digits, upper-case letters and digits, both cases and digits, then encodings with signs.  All want a digit and a letter.
CLASSES = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 3.0),
    ("^[0-9A-Z]+$", 16, 3.4),
    ("^[0-9A-Za-z]+$", 20, 3.7),
    ("^[0-9A-Za-z+/_-]+$", 24, 4.0),
)

#: What a candidate that is no secret matches: identifiers with dashes, dates and times, words joined by signs, with numbers
#: or not, paths, runs of the alphabet, and examples.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^[0-9]{4}[-/_]?[0-9]{2}[-/_]?[0-9]{2}[T_-]?[0-9]*$",
    "^(?:[A-Za-z]+|[0-9]+)(?:[-_/+](?:[A-Za-z]+|[0-9]+))+$",
    "^/?(?:[a-z_-]+[0-9]*/)+[a-z0-9_-]*$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
    "(?:0123456789|abcdefgh|ABCDEFGH|12345678)",
)

SCALE = 1_000_000


def weights(most: int) -> list[int]:
    """c log2 c in millionths, from 0."""
    return [0] + [round(c * log2(c) * SCALE) for c in range(1, most + 1)]


def limit(window: int, bits: float) -> int:
    """The largest sum of c log2 c, in millionths, of a window with so many bits of entropy."""
    return floor(window * (log2(window) - bits) * SCALE)


def _by_class(candidate: Column, value) -> Column:
    out = F.lit(None)
    for entry in reversed(CLASSES):
        out = F.when(candidate.rlike(entry[0]), F.lit(value(entry))).otherwise(out)
    return out


def _hot_windows() -> Column:
    """Of a candidate's codes, window w and limit most: (first, last), the characters before the first window that is high in
    entropy and those up to the end of the last; both 0 if there is none."""
    table = "array({})".format(", ".join(f"{w}L" for w in weights(max(c[1] for c in CLASSES) + 1)))
    judged = "a.i >= w AND a.s <= most"
    seen = f"IF({judged} AND a.last = 0, a.i - w, a.first) AS first, IF({judged}, a.i, a.last) AS last"
    enters, leaves = "codes[i - 1]", "IF(i > w, codes[i - w - 1], 0)"
    falls = f"IF({leaves} > 0, {table}[a.c[{leaves}] - 1] - {table}[a.c[{leaves}]], 0L)"
    step = f"""(a, i) -> IF({enters} = {leaves},
        struct(i AS i, a.c AS c, a.s AS s, {seen}),
        struct(i AS i, transform(a.c, (n, k) -> n + IF(k = {enters}, 1, 0) - IF(k > 0 AND k = {leaves}, 1, 0)) AS c, a.s + {table}[a.c[{enters}] + 1] - {table}[a.c[{enters}]] + {falls} AS s, {seen}))"""
    zero = f"struct(0 AS i, array_repeat(0, {len(ALPHABET) + 1}) AS c, 0L AS s, 0 AS first, 0 AS last)"
    return F.expr(f"aggregate(sequence(1, size(codes)), {zero}, {step}, a -> struct({seen}))")


def scored(candidates: DataFrame) -> DataFrame:
    """``candidates`` (candidate, any others) with ``hot``, as ``_hot_windows`` says; null without a class or on the allow-list."""
    c = F.col("candidate")
    known = c.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | ~(c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    codes = F.expr(f"transform(split(candidate, ''), x -> instr('{ALPHABET}', x))")  # candidates are ASCII
    staged = candidates.select("*", F.when(~known, codes).alias("codes"), _by_class(c, lambda e: e[1]).alias("w"), _by_class(c, lambda e: limit(*e[1:])).cast("long").alias("most"))
    return staged.select("*", F.when(F.size("codes") >= F.col("w"), _hot_windows()).alias("hot")).drop("codes", "w", "most")


ENTROPY = KINDS.index("entropy")


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, k, start, end) of each span of ``rows`` (doc_id, text); of each row at least one, whose k may be null.  A uid's rows are together."""
    kinds = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text", F.explode(F.array(*map(F.lit, range(len(KINDS))))).alias("k"))

    def each(of) -> Column:
        out = of(ENTROPY)
        for k in reversed(range(ENTROPY)):
            out = F.when(F.col("k") == k, of(k)).otherwise(out)
        return out

    columns = kinds.select(
        "uid", "doc_id", "k",
        each(lambda k: F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias("match"),
        F.when(F.col("k") == 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("value"),
        each(lambda k: F.split("text", PATTERNS[k], -1)).alias("gap"),
    )
    found = columns.select("uid", "doc_id", "k", F.posexplode_outer(F.arrays_zip("match", F.coalesce("value", F.array().cast("array<string>")).alias("value"), "gap")).alias("i", "m"))
    light = found.where((F.col("k") == 0) | F.col("m.match").isNotNull()).select(
        "uid", "doc_id", "k", "i", F.coalesce(F.length("m.gap"), F.lit(0)).alias("gap"), F.coalesce(F.length("m.match"), F.lit(0)).alias("n"),
        F.when(F.col("k") == 0, F.length("m.value") >= VALUE).otherwise(F.lit(True)).alias("counts"),
        F.when(F.col("k") == ENTROPY, F.col("m.match")).alias("candidate"),
    )
    judged = scored(light).drop("candidate").repartition("uid")
    so_far = Window.partitionBy("uid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entropy = F.col("k") == ENTROPY
    hot = F.coalesce(F.col("hot.last") > 0, F.lit(False))
    placed = judged.withColumn("at", F.sum(F.col("gap") + F.col("n")).over(so_far) - F.col("n")).select(
        "uid", "doc_id", "k",
        (F.col("at") + F.when(entropy, F.col("hot.first")).otherwise(F.lit(0))).alias("start"),
        (F.col("at") + F.when(entropy, F.col("hot.last")).otherwise(F.col("n"))).alias("end"),
        (F.coalesce(F.col("counts"), F.lit(False)) & (~entropy | hot)).alias("counts"),
    )
    base = F.col("counts") & (F.col("k") != ENTROPY)
    in_order = Window.partitionBy("uid").orderBy("start", "k")
    earlier = F.max(F.when(base, F.col("end"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    later = F.min(F.when(base, F.col("start"))).over(in_order.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    stays = F.col("counts") & ((F.col("k") != ENTROPY) | ~(F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))))
    return placed.select("uid", "doc_id", F.when(stays, F.col("k")).alias("k"), "start", "end")


_ANY = "|".join(f"(?:{p})" for p in PATTERNS)


def spans(docs: DataFrame) -> DataFrame:
    """One row for each span: doc_id, kind, start, end (code points, end exclusive)."""
    found = _placed(_text(docs).where(F.col("text").rlike(_ANY))).where(F.col("k").isNotNull())
    return found.select("doc_id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1).alias("kind"), "start", "end")


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    rows = _text(docs)
    some = F.col("text").rlike(_ANY)
    found = _placed(rows.where(some)).groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("start", "k", "end")))).alias("s"))
    every = found.select("doc_id", "s").unionByName(rows.where(~some).select("doc_id", F.array().cast(found.schema["s"].dataType).alias("s")))
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    joined = f"array_join(transform({{}}, x -> concat({names}[x.k], ':', x.start, ':', x.end)), ',')"
    base = f"filter(s, x -> x.k < {ENTROPY})"
    counts = [F.expr(f"CAST(size(filter(s, x -> x.k = {k})) AS BIGINT) AS n_{name}") for k, name in enumerate(KINDS)]
    return every.select("doc_id", *counts[:ENTROPY], F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("s")).alias("spans"), counts[ENTROPY])
