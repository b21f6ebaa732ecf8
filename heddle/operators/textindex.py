"""A stored full-text index over blocks - their heading paths and texts, without diacritics - its BM25 search, and evidence packs that use it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.columns import token_estimate
from heddle.operators.evidence import word_list
from heddle.operators.splitting import with_paths
from heddle.sources.store import fresh_path
from heddle.sources.views import blocks, evidence, table

BUCKETS = 16
K1, B = 1.2, 0.75
QUERY_WORDS = 16
ASKED = 50_000  # rows of queries that every task may hold
SCORES = 1 << 20  # scores that a task holds at once


@cache
def _marked_letters() -> tuple[str, str]:
    """Letters that Unicode decomposes into a letter and marks, and these letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:]) and unicodedata.category(d[0])[0] == "L"]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def plain_letters(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), *_marked_letters()), r"\p{M}+", "")


def terms_of(text: Column) -> Column:
    return word_list(plain_letters(text))


class TextIndex:
    """An index as it is stored: the blocks with their sorted words, postings in folders by bucket of the term, sorted by term in each file, the terms with their
    numbers of blocks, and one row of totals."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def terms(self) -> DataFrame:
        """(term, df): in how many blocks each term occurs."""
        return self.spark.read.parquet(f"{self.path}/terms")

    def _stored(self, terms: DataFrame | None = None) -> DataFrame:
        stored = self.spark.read.parquet(f"{self.path}/postings")
        if terms is not None:
            buckets = [r["bucket"] for r in terms.select(bucket_of(F.col("term")).alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
            stored = stored.where(F.col("bucket").isin(buckets))
        return stored

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, df, doc_id, idx, tf, words) of all ``terms`` (term); only their buckets are read."""
        known = self.terms() if terms is None else self.terms().join(terms.select("term").distinct(), "term", "left_semi")
        return self._stored(terms).join(known, "term").select("term", "df", "doc_id", "idx", "tf", "words")

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    def search(self, queries: DataFrame, keys: list[str], most: int = 10, within: bool = False) -> DataFrame:
        """(``keys``, place, doc_id, idx, score): the best blocks of each query (``keys``, term) by BM25; any of its terms may match.
        ``within``: only blocks of the query's own doc_id, which is then one of the keys."""
        by = [*keys, *(c for c in ("doc_id", "idx") if c not in keys)]
        if not within and queries.count() <= ASKED:
            hits = self._best(queries, keys, most)
        else:
            on = ["term", "doc_id"] if within else ["term"]
            met = self._stored(queries).join(queries.join(self.terms(), "term"), on).crossJoin(F.broadcast(self.totals()))  # one row of totals
            idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.col("mean_words")))
            hits = met.select(*by, weight.alias("weight")).groupBy(*by).agg(F.round(F.sum("weight"), 9).alias("score"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id", "idx"))
        return hits.withColumn("place", place).where(F.col("place") <= most).select(*by, "place", "score")

    def _best(self, queries: DataFrame, keys: list[str], most: int) -> DataFrame:
        """(``keys``, doc_id, idx, score): for few queries, hits among which are the best of each.  A block's words are in its own row, so
        that each task scores its blocks and hands on ``most`` for each query: no score is shuffled but these."""
        rows = queries.join(self.terms(), "term").select(*keys, "term", "df").collect()  # at most ASKED
        names = {k: i for i, k in enumerate(dict.fromkeys(tuple(r[c] for c in keys) for r in rows))}
        df = {r["term"]: r["df"] for r in rows}
        terms = {t: i for i, t in enumerate(sorted(df))}
        (n, mean) = self.totals().first()
        pairs = sorted((terms[r["term"]], names[tuple(r[c] for c in keys)]) for r in rows)
        idf = np.log(1 + (n - np.array([df[t] for t in terms]) + 0.5) / (np.array([df[t] for t in terms]) + 0.5))
        score = _scorer(list(terms), idf, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), len(names), mean, most)
        stored = self.spark.read.parquet(f"{self.path}/blocks")
        kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
        found = stored.select("doc_id", "idx", "lone", "w").mapInArrow(score, f"_query int, doc_id {kinds['doc_id']}, idx {kinds['idx']}, lone boolean, score double")
        hits = found.groupBy("_query", "doc_id", "idx").agg(F.sum("score").alias("score"), F.every("lone").alias("lone"))
        hits = hits.withColumn("score", F.when(F.col("lone"), F.col("score")).otherwise(F.round("score", 9)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.select(*keys).schema)
        asked = self.spark.createDataFrame([(i, *k) for k, i in names.items()], f"_query int, {fields}")
        return hits.join(F.broadcast(asked), "_query").select(*keys, "doc_id", "idx", "score")


def _scorer(terms: list[str], idf: np.ndarray, asked: np.ndarray, by: np.ndarray, queries: int, mean: float, most: int):
    """For mapInArrow over blocks (doc_id, idx, lone, w): the ``most`` best of a task's blocks for each query, with rounded scores; blocks that share
    their doc_id and idx (not ``lone``) all, with what each adds to the score.  ``asked``, ``by``: the terms and the queries that ask for them, by term."""
    start = np.searchsorted(asked, np.arange(len(terms) + 1))

    def scores(words: pa.ListArray) -> np.ndarray:
        """(block, query)"""
        length = words.value_lengths().to_numpy()
        number = pc.index_in(words.flatten(), value_set=pa.array(terms, pa.string()))
        known = number.is_valid().to_numpy(zero_copy_only=False)
        block = np.repeat(np.arange(len(length)), length)[known]
        at, tf = np.unique(block * len(terms) + number.drop_null().to_numpy(), return_counts=True)
        block, term = at // len(terms), at % len(terms)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[block] / mean))
        times = start[term + 1] - start[term]
        query = by[np.repeat(start[term] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        return np.bincount(np.repeat(block, times) * queries + query, np.repeat(weight, times), len(length) * queries).reshape(-1, queries)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best, least = ["_query", "doc_id", "idx", "lone", "score"], None, np.zeros(queries)
        for batch in batches if queries else ():
            for first in range(0, batch.num_rows, max(1, SCORES // queries)):
                part = batch.slice(first, max(1, SCORES // queries))
                lone, raw = part.column("lone").to_numpy(zero_copy_only=False), scores(part.column("w"))
                rounded = np.where(lone[:, None], np.floor(raw * 1e9 + 0.5) / 1e9, raw)
                if len(raw) >= most:  # so many are at least as good as the last of them
                    least = np.maximum(least, np.partition(np.where(lone[:, None], rounded, 0), -most, axis=0)[-most])

                def table(wanted: np.ndarray) -> pa.Table:
                    block, query = np.nonzero(wanted)
                    rows = part.select(["doc_id", "idx", "lone"]).take(pa.array(block))
                    return pa.table([pa.array(query, pa.int32()), *rows.columns, pa.array(rounded[block, query])], names=names)

                if not lone.all():
                    yield from table((raw > 0) & ~lone[:, None]).to_batches()
                new = table((raw > 0) & lone[:, None] & (rounded >= least))
                if not len(new):
                    continue
                best = new if best is None else pa.concat_tables([best, new])
                best = best.take(pc.sort_indices(best, [("_query", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("idx", "ascending")], null_placement="at_start"))
                query = best.column("_query").to_numpy()
                place = np.arange(len(query)) - np.searchsorted(query, query)
                best = best.filter(pa.array(place < most)).combine_chunks()
                query = best.column("_query").to_numpy()
                full = np.bincount(query, minlength=queries) >= most
                least[full] = np.maximum(least[full], best.column("score").to_numpy()[np.searchsorted(query, np.flatnonzero(full), side="right") - 1])
        if best is not None:
            yield from best.to_batches()

    return body


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(b: DataFrame, path: str) -> TextIndex:
    """Writes the index of blocks (doc_id, idx, text, path).  A block's postings come from its own row, and each task sorts and writes those of
    its blocks: neither they nor a frequent term are shuffled, only the numbers of blocks of each term.  ``lone``: no other block has its doc_id and idx."""
    words = b.select("doc_id", "idx", F.array_sort(terms_of(F.concat(F.array_join("path", " / "), F.lit(" / "), F.col("text")))).alias("w")).where(F.size("w") > 0)
    words = words.withColumn("lone", F.count("*").over(Window.partitionBy("doc_id").orderBy("idx").rangeBetween(0, 0)) == 1)
    words.write.option("compression", "zstd").parquet(f"{path}/blocks")
    words = b.sparkSession.read.parquet(f"{path}/blocks")
    begins = words.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get(F.col("w"), i) != F.get(F.col("w"), i - 1))))
    runs = F.transform("at", lambda p, k: F.struct(F.get(F.col("w"), p).alias("term"), (F.coalesce(F.get(F.col("at"), k + 1), F.size("w")) - p).cast("long").alias("tf")))
    postings = begins.select("doc_id", "idx", F.size("w").alias("words"), F.explode_outer(runs).alias("p")).select("p.term", "doc_id", "idx", "words", "p.tf").withColumn("bucket", bucket_of(F.col("term")))
    postings.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    TextIndex(b.sparkSession, path)._stored().groupBy("term").agg(F.count("*").alias("df")).write.option("compression", "zstd").parquet(f"{path}/terms")
    words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean_words")).write.parquet(f"{path}/totals")
    return TextIndex(b.sparkSession, path)


_built: dict[tuple, TextIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the blocks of ``sf_dir``, written once for a session and its files."""
    files = table(spark, sf_dir, "documents").inputFiles()
    key = (spark.sparkContext.applicationId, sf_dir, *sorted(files))
    if key not in _built:
        _built[key] = build(with_paths(blocks(spark, sf_dir)), fresh_path(spark))
    return _built[key]


def query_terms(text: Column) -> Column:
    """The first sixteen distinct words over two letters."""
    return F.slice(F.array_distinct(F.filter(terms_of(text), lambda w: F.length(w) > 2)), 1, QUERY_WORDS)


def e45_index_terms(spark, sf_dir):
    """What the index holds, by in how many blocks a term occurs."""
    terms = stored_index(spark, sf_dir).postings().groupBy("term").agg(F.first("df").alias("df"), F.sum("tf").alias("tf"), F.count("*").alias("n"))
    return terms.groupBy("df").agg(F.count("*").alias("terms"), F.sum("tf").alias("uses"), F.min("term").alias("least_term"), F.count_if(F.col("n") != F.col("df")).alias("wrong"))


def e46_bm25(spark, sf_dir, most: int = 10):
    """Ten best blocks for each benchmark item by BM25, from the stored index."""
    query = table(spark, sf_dir, "benchmark").select("item_id", F.explode(query_terms(F.col("text"))).alias("term"))
    return stored_index(spark, sf_dir).search(query, ["item_id"], most).select("item_id", "place", "doc_id", "idx", "score")


def evidence_packs(claims: DataFrame, b: DataFrame, hits: DataFrame, distance: Column, budget: Column) -> DataFrame:
    """Packs of segments (doc_id, segment).

    ``claims`` (doc_id, segment, idx): the blocks of a segment's evidence, which are always in.  Then, under what is left of ``budget`` (of the
    number of claims): the blocks before and behind them, up to ``distance`` (of ``b``'s columns) places away, those before first and the farthest
    of the last first; then ``hits`` (doc_id, segment, idx, place).  A block has the first reason that names it; one that doesn't fit is passed over.
    ``b``: doc_id, idx, tokens and what ``distance`` needs."""
    key = ["doc_id", "segment"]
    sized = b.select("doc_id", "idx", "tokens", distance.alias("distance"))
    originals = claims.select(*key, "idx").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("idx")))
    held = originals.join(sized, ["doc_id", "idx"])
    steps = held.where("distance > 0").select(*key, "idx", "pos", F.explode(F.sequence(F.lit(1), "distance")).alias("step"))
    before = steps.select(*key, (F.col("idx") - F.col("step")).alias("idx"), F.struct(F.lit(0).alias("kind"), (-F.col("pos")).alias("a"), (-F.col("step")).alias("b")).alias("reason"))
    behind = steps.select(*key, (F.col("idx") + F.col("step")).alias("idx"), F.struct(F.lit(1).alias("kind"), F.col("pos").alias("a"), F.col("step").alias("b")).alias("reason"))
    found = hits.select(*key, "idx", F.struct(F.lit(2).alias("kind"), F.col("place").alias("a"), F.lit(0).alias("b")).alias("reason"))
    first = before.unionByName(behind).unionByName(found).groupBy(*key, "idx").agg(F.min("reason").alias("reason"))
    context = first.join(originals.select(*key, "idx"), [*key, "idx"], "left_anti").join(sized.drop("distance"), ["doc_id", "idx"])
    context = context.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("reason", "idx", "tokens"))).alias("items"))
    sums = held.groupBy(*key).agg(F.count("*").alias("originals"), F.sum("tokens").alias("original_tokens"))
    packs = sums.join(claims.groupBy(*key).agg(F.count("*").alias("claims")), key).withColumn("budget", budget)
    packs = packs.join(context, key, "left").withColumn("room", F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("original_tokens")))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<kind: int, idx: bigint>>").alias("taken"))

    def step(state, x):
        fits = state["used"] + x["tokens"] <= F.col("room")
        one = F.struct(x["reason"]["kind"].alias("kind"), x["idx"].alias("idx"))
        return F.struct(F.when(fits, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"), F.when(fits, F.concat(state["taken"], F.array(one))).otherwise(state["taken"]).alias("taken"))

    none = F.array().cast(packs.schema["items"].dataType)
    packs = packs.withColumn("items", F.coalesce("items", none)).withColumn("fold", F.aggregate("items", empty, step))
    kind = lambda k: F.size(F.filter("fold.taken", lambda t: t["kind"].isin(*k)))
    listed = F.array_join(F.transform("fold.taken", lambda t: t["idx"].cast("string")), ",")
    return packs.select(*key, "claims", "originals", "original_tokens", "budget", kind([0, 1]).alias("neighbours"), kind([2]).alias("hits"), (F.col("original_tokens") + F.col("fold.used")).alias("actual_tokens"), (F.col("original_tokens") > F.col("budget")).alias("over_budget"), listed.alias("context"))


LEAST, MOST, EACH = 120, 900, 40  # tokens of a pack: 1800, 18000 and 1400 a minute in production


def e43_evidence_packs(spark, sf_dir):
    """Packs of the claims of a document that share a term: their blocks, neighbours by source, and hits of the index in the document."""
    e = evidence(spark, sf_dir).where("term is not null").select("doc_id", F.col("term").alias("segment"), "idx", "claim")
    b = blocks(spark, sf_dir).select("doc_id", "idx", "source", token_estimate(F.col("text")).alias("tokens"))
    said = e.groupBy("doc_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "claim"))), lambda x: x["claim"]), " ").alias("text"))
    query = said.select("doc_id", "segment", F.explode(query_terms(F.col("text"))).alias("term"))
    hits = stored_index(spark, sf_dir).search(query, ["doc_id", "segment"], 10, within=True)
    packs = evidence_packs(e, b, hits, 1 + F.length("source") % 2, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.col("claims") * EACH)).cast("long"))
    return packs.withColumn("context_md5", F.md5(F.col("context").cast("binary"))).drop("context")


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "e" and name[1:3].isdigit()}


def _sql() -> dict[str, str]:
    from heddle.operators.splitting import SQL as SPLIT
    from heddle.plans.document_sql import tokens

    paths = SPLIT["b02_heading_paths"].split(" SELECT doc_id, count(DISTINCT")[0].removeprefix("WITH ")
    words = lambda x: rf"regexp_extract_all(strip_accents(lower({x})), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    asked = lambda x: f"array_slice(list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN length({x}[i]) > 2 AND list_position({x}, {x}[i]) = i THEN {x}[i] END), lambda u: u IS NOT NULL), 1, {QUERY_WORDS})"
    index = f"""{paths}, bw AS (SELECT doc_id, idx, {words("array_to_string(path, ' / ') || ' / ' || text")} AS w FROM paths), kept AS (SELECT * FROM bw WHERE len(w) > 0),
        tf AS (SELECT doc_id, idx, words, term, count(*) AS tf FROM (SELECT doc_id, idx, len(w) AS words, unnest(w) AS term FROM kept) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals AS (SELECT count(*) AS n, avg(len(w)) AS mean_words FROM kept),
        weights AS (SELECT doc_id, idx, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * words / mean_words)) AS weight FROM tf JOIN df USING (term), totals)"""
    return {
        "e45_index_terms": f"WITH {index} SELECT df, count(*) AS terms, sum(uses)::BIGINT AS uses, min(term) AS least_term, 0::BIGINT AS wrong FROM (SELECT term, any_value(df) AS df, sum(tf) AS uses FROM tf JOIN df USING (term) GROUP BY term) GROUP BY df",
        "e46_bm25": f"""WITH {index}, qw AS (SELECT item_id, {words("text")} AS w FROM benchmark), q AS (SELECT item_id, unnest({asked("w")}) AS term FROM qw),
            s AS (SELECT item_id, doc_id, idx, round(sum(weight), 9) AS score FROM q JOIN weights USING (term) GROUP BY ALL)
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx)::INT AS place, doc_id, idx, score FROM s QUALIFY place <= 10""",
        "e43_evidence_packs": f"""WITH RECURSIVE {index}, c AS (SELECT doc_id, term AS segment, idx, claim FROM evidence WHERE term IS NOT NULL), z AS (SELECT doc_id, idx, source, {tokens()} AS tokens, 1 + length(source) % 2 AS distance FROM blocks),
            qw AS (SELECT doc_id, segment, {words("string_agg(claim, ' ' ORDER BY idx)")} AS w FROM c GROUP BY ALL), q AS (SELECT doc_id, segment, unnest({asked("w")}) AS term FROM qw),
            h AS (SELECT doc_id, segment, idx, round(sum(weight), 9) AS score FROM q JOIN weights USING (term, doc_id) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment ORDER BY score DESC, idx) AS place FROM h QUALIFY place <= 10),
            o AS (SELECT doc_id, segment, idx, row_number() OVER (PARTITION BY doc_id, segment ORDER BY idx) AS pos FROM (SELECT DISTINCT doc_id, segment, idx FROM c)), oz AS (SELECT * FROM o JOIN z USING (doc_id, idx)),
            st AS (SELECT doc_id, segment, idx, pos, unnest(range(1, distance + 1)) AS step FROM oz),
            ca AS (SELECT doc_id, segment, idx - step AS idx, 0 AS kind, -pos AS a, -step AS b FROM st UNION ALL SELECT doc_id, segment, idx + step, 1, pos, step FROM st UNION ALL SELECT doc_id, segment, idx, 2, place, 0 FROM t),
            f AS (SELECT doc_id, segment, idx, min({{'kind': kind, 'a': a, 'b': b}}) AS reason FROM ca GROUP BY ALL),
            x AS (SELECT doc_id, segment, idx, reason, tokens, row_number() OVER (PARTITION BY doc_id, segment ORDER BY reason, idx) AS r FROM f JOIN z USING (doc_id, idx) WHERE NOT EXISTS (FROM o WHERE o.doc_id = f.doc_id AND o.segment = f.segment AND o.idx = f.idx)),
            m AS (SELECT doc_id, segment, count(*) AS originals, sum(tokens)::BIGINT AS original_tokens FROM oz GROUP BY ALL), n AS (SELECT doc_id, segment, count(*) AS claims, greatest({LEAST}, least({MOST}, count(*) * {EACH}))::BIGINT AS budget FROM c GROUP BY ALL),
            g AS (SELECT doc_id, segment, 0::BIGINT AS r, 0::BIGINT AS used, greatest(0, budget - original_tokens)::BIGINT AS room, 0 AS near, 0 AS found, '' AS listed FROM m JOIN n USING (doc_id, segment)
                UNION ALL SELECT g.doc_id, g.segment, x.r, g.used + v.takes * x.tokens, room, near + v.takes * (reason.kind < 2)::INT, found + v.takes * (reason.kind = 2)::INT, CASE WHEN v.takes = 1 THEN listed || CASE WHEN listed = '' THEN '' ELSE ',' END || x.idx ELSE listed END
                FROM g JOIN x ON x.doc_id = g.doc_id AND x.segment = g.segment AND x.r = g.r + 1, LATERAL (SELECT (g.used + x.tokens <= g.room)::INT AS takes) v)
            SELECT doc_id, segment, claims, originals, original_tokens, budget, near AS neighbours, found AS hits, original_tokens + used AS actual_tokens, original_tokens > budget AS over_budget, md5(listed) AS context_md5
            FROM g JOIN m USING (doc_id, segment) JOIN n USING (doc_id, segment) QUALIFY row_number() OVER (PARTITION BY doc_id, segment ORDER BY r DESC) = 1""",
    }


SQL = _sql()
