"""Checking and merging of drafts: evidence against its blocks, claims against budgets, reuse against stored identities.

``SQL`` holds the same rules for DuckDB, over the views of heddle.sources.views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import half_even, token_estimate
from heddle.operators.documents import by_doc, heading_runs, pack_in_order
from heddle.sources.views import blocks, cells, evidence, table

LEAST_EXCERPT = 12


def violations(rows: DataFrame, kinds: dict[str, Column], *keys: str) -> DataFrame:
    """One row for each violated rule with its number: (keys, kind, n)."""
    found = F.array_compact(F.array(*[F.when(when, F.lit(kind)) for kind, when in kinds.items()]))
    return rows.select(*keys, found.alias("_kinds")).select(*keys, F.explode("_kinds").alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def contained(excerpt: str, text: str) -> Column:
    return F.instr(F.col(text), F.col(excerpt)) > 0


def e05_evidence_violations(spark, sf_dir):
    """Evidence whose id repeats in its document, whose excerpt is short or not in its block, or whose pages leave the block's."""
    e = evidence(spark, sf_dir).withColumn("same_id", F.count("*").over(Window.partitionBy("doc_id", "evidence_id")))
    outside = (F.col("page_start") > F.col("page")) | (F.col("page_end") < F.col("page"))
    kinds = {"repeated_id": F.col("same_id") > 1, "short_excerpt": F.length("excerpt") < LEAST_EXCERPT, "not_in_block": ~contained("excerpt", "text"), "outside_block": outside}
    return violations(e, kinds, "doc_id")


def e06_collection_audit(spark, sf_dir):
    """Blocks without a record and ids that several documents use, by document."""
    b, e = blocks(spark, sf_dir).select("doc_id", "idx"), evidence(spark, sf_dir).select("doc_id", "idx", "evidence_id")
    missing = b.join(e.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing_blocks"))
    shared = e.groupBy("evidence_id").agg(F.countDistinct("doc_id").alias("docs")).where("docs > 1")
    repeated = e.join(shared, "evidence_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared_ids"))
    return missing.join(repeated, "doc_id", "full").select("doc_id", F.coalesce("missing_blocks", F.lit(0)).alias("missing_blocks"), F.coalesce("shared_ids", F.lit(0)).alias("shared_ids"))


def e07_locators(spark, sf_dir):
    kinds = {"order": F.col("page_end") < F.col("page_start"), "beyond": F.col("page_end") > F.col("page"), "before": F.col("page_start") < F.col("page")}
    return violations(evidence(spark, sf_dir), kinds, "source")


def e08_draft_rules(spark, sf_dir, budget: int = 3):
    """Pages whose drafts repeat a claim or hold more than the budget."""
    by = evidence(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("claims"), F.countDistinct("claim").alias("texts"))
    return violations(by, {"repeated_claim": F.col("texts") < F.col("claims"), "over_budget": F.col("claims") > budget}, "doc_id")


def type_fault() -> Column:
    return F.when((F.col("claim_type") == "definition") & F.col("term").isNull(), "no_term").when((F.col("claim_type") == "distinction") & ~F.col("has_contrast"), "no_contrast")


def e09_type_fields(spark, sf_dir):
    return evidence(spark, sf_dir).withColumn("fault", type_fault()).where("fault is not null").groupBy("source", "fault").agg(F.count("*").alias("n"))


def valid(e: DataFrame) -> DataFrame:
    return e.where((F.length("excerpt") >= LEAST_EXCERPT) & contained("excerpt", "text") & type_fault().isNull())


def e10_salvaged_drafts(spark, sf_dir, most: int = 2):
    """The first valid and different claims of each page, up to the cap, and how many were left."""
    e = evidence(spark, sf_dir)
    first = valid(e).groupBy("doc_id", "page", "claim").agg(F.min("idx").alias("idx"))
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx"))).where(F.col("place") <= most)
    kept = kept.groupBy("doc_id", "page").agg(F.count("*").alias("kept"), F.sum("idx").alias("idx_sum"))
    drafts = e.groupBy("doc_id", "page").agg(F.count("*").alias("drafts"))
    return drafts.join(kept, ["doc_id", "page"], "left").select("doc_id", "page", "drafts", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("idx_sum", F.lit(0)).alias("idx_sum"))


def e11_sibling_excerpts(spark, sf_dir):
    """Where excerpts are: in their own block, in the next block of the document, or nowhere."""
    b = blocks(spark, sf_dir)
    following = b.select("doc_id", (F.col("idx") - 1).alias("idx"), F.col("text").alias("sibling"))
    e = evidence(spark, sf_dir).join(following, ["doc_id", "idx"], "left")
    place = F.when(contained("excerpt", "text"), "own").when(F.coalesce(contained("excerpt", "sibling"), F.lit(False)), "sibling").otherwise("nowhere")
    return e.groupBy("doc_id", place.alias("place")).agg(F.count("*").alias("n"))


def e12_merged_claims(spark, sf_dir):
    """Claims of earlier drafts (odd pages) stay; of new ones (even pages) only texts that none has, each once."""
    e = evidence(spark, sf_dir).select("doc_id", "page", "claim")
    prior, new = e.where("page % 2 = 1"), e.where("page % 2 = 0")
    added = new.join(prior.select("doc_id", "claim"), ["doc_id", "claim"], "left_anti").select("doc_id", "claim").distinct()
    both = prior.select("doc_id", F.lit("prior").alias("origin")).unionByName(added.select("doc_id", F.lit("added").alias("origin")))
    return both.groupBy("doc_id", "origin").agg(F.count("*").alias("claims"))


def e14_extraction_units(spark, sf_dir, tokens: int = 400):
    """Consecutive blocks in units under a token cap (12,000 in production); how many units and the largest."""
    b = blocks(spark, sf_dir).select("doc_id", "idx", token_estimate(F.col("text")).alias("tokens"), F.lit(False).alias("alone"))
    docs = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", "alone"))).alias("items"))
    binned = docs.select("doc_id", "items", pack_in_order(F.col("items"), tokens, tokens).alias("bins"))
    flat = binned.select("doc_id", F.explode(F.arrays_zip("items", "bins")).alias("x")).groupBy("doc_id", F.col("x.bins").alias("unit")).agg(F.sum("x.items.tokens").alias("tokens"))
    return flat.groupBy("doc_id").agg(F.count("*").alias("units"), F.max("tokens").alias("largest"))


def e15_evidence_ids(spark, sf_dir):
    key = F.concat(F.lit("ev-"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("idx").cast("string"), "claim", "excerpt").cast("binary"), 256), 1, 16))
    return evidence(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct(key).alias("ids"), F.min(key).alias("least"), F.max(key).alias("greatest"))


def e16_circuit_breaker(spark, sf_dir, skips: int = 3):
    """Documents whose first ``skips`` or more units are all skipped (nothing valid) before any success."""
    good = valid(evidence(spark, sf_dir)).groupBy("doc_id").agg(F.min("idx").alias("first_good"))
    units = evidence(spark, sf_dir).select("doc_id", "idx").join(good, "doc_id", "left")
    by = units.groupBy("doc_id").agg(F.count_if(F.coalesce(F.col("idx") < F.col("first_good"), F.lit(True))).alias("skipped"))
    return by.select("doc_id", "skipped", (F.col("skipped") >= skips).alias("aborts"))


def e17_profiles(spark, sf_dir):
    """Coverage, claim cap, neighbours and token budget by duration tier; minutes are an order's."""
    minutes = F.col("o_orderkey") % 130
    tier = F.when(minutes <= 10, 1).when(minutes <= 30, 2).when(minutes <= 60, 3).otherwise(4)
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("tier"))
    return table(spark, sf_dir, "orders").withColumn("tier", tier).groupBy("tier").agg(F.count("*").alias("briefs")).select("tier", "briefs", pick(0.15, 0.35, 0.6, 1.0).alias("coverage"), pick(2, 3, 4, 6).alias("claims"), pick(0, 1, 1, 2).alias("neighbours"))


def eligible(spark, sf_dir) -> DataFrame:
    """Blocks that are no notes (text that starts with a digit or bracket); all of a document that has nothing else."""
    b = blocks(spark, sf_dir).withColumn("note", F.col("text").rlike(r"^[0-9(|#]"))
    return b.withColumn("only_notes", F.min("note").over(Window.partitionBy("doc_id"))).where(~F.col("note") | F.col("only_notes"))


def e18_eligible_blocks(spark, sf_dir):
    return eligible(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("only_notes").alias("only_notes"), F.sum("idx").alias("idx_sum"))


def e19_note_like(spark, sf_dir, lines: int = 2):
    """Documents with so many lines that look like notes (eight in production)."""
    return blocks(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("text").rlike(r"^[0-9(|#]")).alias("note_lines")).withColumn("note_like", F.col("note_lines") >= lines)


def targets(spark, sf_dir, coverage: float = 0.35, budget: int = 3000) -> DataFrame:
    by = eligible(spark, sf_dir).groupBy("doc_id").agg(F.sum(token_estimate(F.col("text"))).alias("total"))
    return by.withColumn("target", F.least("total", F.ceil(F.col("total") * coverage * 1.1), F.lit(budget)))


def e21_target_tokens(spark, sf_dir):
    return targets(spark, sf_dir)


def e23_exhaustive(spark, sf_dir):
    return targets(spark, sf_dir, 0.9).select("doc_id", (F.col("target") >= F.col("total")).alias("exhaustive"))


def e24_cell_batches(spark, sf_dir, most: int = 120):
    """Blocks (suppliers) of an order go to its first cell; groups over the size become several batches."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("cell"), F.sum(F.floor("l_quantity")).alias("tokens"))
    groups = lines.groupBy("cell").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))
    return groups.withColumn("batches", F.ceil(F.col("tokens") / most))


def e25_section_seeds(spark, sf_dir):
    """The first block after the heading of each section, once for each document and block."""
    r = heading_runs(spark, sf_dir).where("run > 0 and not is_heading")
    return r.groupBy("doc_id", "run").agg(F.min("idx").alias("seed")).groupBy("doc_id").agg(F.countDistinct("seed").alias("seeds"), F.sum("seed").alias("seed_sum"))


def e26_serialised_batches(spark, sf_dir, most: int = 600):
    """Evidence in order, in batches under a size in characters; none is lost."""
    e = evidence(spark, sf_dir).select("doc_id", "idx", (F.length("excerpt") + F.length("claim")).cast("long").alias("tokens"), F.lit(False).alias("alone"))
    docs = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "tokens", "alone"))).alias("items"))
    bins = pack_in_order(F.col("items"), most, most)
    return docs.select("doc_id", F.size("items").alias("items"), (F.array_max(bins) + 1).alias("batches"))


def e28_merge_groups(spark, sf_dir):
    """Groups (orders) of claims (parts): members in several groups, groups of several types, canonical members that are outside."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("member"), F.col("l_returnflag").alias("type"), "l_suppkey")
    many = lines.groupBy("member").agg(F.countDistinct("grp").alias("n")).where("n > 1").agg(F.count("*").alias("n")).select(F.lit("not_disjoint").alias("kind"), "n")
    groups = lines.groupBy("grp").agg(F.countDistinct("type").alias("types"), F.max("l_suppkey").alias("canonical"), F.collect_set("member").alias("members"))
    of_groups = violations(groups, {"several_types": F.col("types") > 1, "canonical_outside": ~F.array_contains("members", F.col("canonical"))})
    return many.unionByName(of_groups)


def e30_ledger(spark, sf_dir):
    """Each claim with its evidence: how many items and sources, and the strongest confidence."""
    return evidence(spark, sf_dir).groupBy("claim").agg(F.count("*").alias("items"), F.countDistinct("doc_id").alias("sources"), F.max("confidence").alias("best")).where("items > 1").select(F.md5(F.col("claim").cast("binary")).alias("claim_md5"), "items", "sources", "best")


def e31_passthrough(spark, sf_dir):
    """One claim for each item; its support from type and confidence."""
    support = F.when(F.col("claim_type") == "example", "moderate").when(F.col("confidence") >= 0.75, "strong").when(F.col("confidence") >= 0.4, "moderate").otherwise("uncertain")
    return evidence(spark, sf_dir).groupBy("source", support.alias("support")).agg(F.count("*").alias("claims"))


def e33_claim_ids(spark, sf_dir):
    """Ids from source, claim and the sorted ids of the evidence."""
    by = evidence(spark, sf_dir).groupBy("doc_id", "claim").agg(F.array_join(F.array_sort(F.collect_set("evidence_id")), ",").alias("ids"))
    key = F.concat(F.lit("clm-"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "claim", "ids").cast("binary"), 256), 1, 16))
    return by.groupBy("doc_id").agg(F.count("*").alias("claims"), F.min(key).alias("least"))


def successive_orders(spark, sf_dir) -> DataFrame:
    """Each order of a customer beside the one before: stored and current identity fields."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 3).alias("depth"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 2).alias("mode"), (F.col("o_orderkey") % 5).alias("tier"))
    for name in ("o_orderstatus", "o_orderpriority", "depth", "mode", "tier"):
        o = o.withColumn(f"was_{name}", F.lag(name).over(w))
    return o.withColumn("known", F.row_number().over(w) > 1)


PROFILE = ["o_orderstatus", "o_orderpriority", "depth", "mode", "tier"]


def first_mismatch() -> Column:
    """The first field that differs, in order; null where all are equal (null equals null)."""
    return F.coalesce(*[F.when(~F.col(n).eqNullSafe(F.col(f"was_{n}")), F.lit(n.removeprefix("o_order"))) for n in PROFILE])


def e36_compatible_profiles(spark, sf_dir):
    same = F.lit(True)
    for n in PROFILE[1:]:
        same = same & F.col(n).eqNullSafe(F.col(f"was_{n}"))
    return successive_orders(spark, sf_dir).where("known").groupBy("o_orderstatus").agg(F.count("*").alias("pairs"), F.count_if(same).alias("compatible"))


def e61_reuse_reasons(spark, sf_dir):
    """Whether a stored extraction is reused, or the first reason against it."""
    reason = F.when(~F.col("known"), "absent").otherwise(F.coalesce(first_mismatch(), F.lit("hit")))
    return successive_orders(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("plans"))


def e79_reused_plans(spark, sf_dir, minutes: int = 40):
    """Plans with equal keys are reused and their verdict is taken anew for the new duration."""
    o = successive_orders(spark, sf_dir).where("known").withColumn("same", F.col("o_orderpriority").eqNullSafe(F.col("was_o_orderpriority")))
    verdict = F.when(~F.col("same"), "redo").when(F.col("o_orderkey") % 100 >= minutes, "continue").otherwise("stop")
    return o.groupBy("o_orderpriority", verdict.alias("verdict")).agg(F.count("*").alias("plans"))


def e80_miss_reasons(spark, sf_dir):
    return successive_orders(spark, sf_dir).where("known").select("o_custkey", F.coalesce(first_mismatch(), F.lit("reuse")).alias("reason")).groupBy("o_custkey").agg(F.count_if(F.col("reason") == "reuse").alias("reused"), F.min("reason").alias("first_reason"), F.count("*").alias("plans"))


def e81_carried_forward(spark, sf_dir):
    """Extractions of blocks that the new plan (R lines) keeps are carried over, the others are made anew."""
    l = table(spark, sf_dir, "lineitem")
    old, new = l.where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey").distinct(), l.where("l_returnflag <> 'N'").select("l_orderkey", "l_suppkey").distinct()
    kept = new.join(old, ["l_orderkey", "l_suppkey"], "left_semi").agg(F.count("*").alias("blocks")).select(F.lit("carried").alias("state"), "blocks")
    made = new.join(old, ["l_orderkey", "l_suppkey"], "left_anti").agg(F.count("*").alias("blocks")).select(F.lit("redone").alias("state"), "blocks")
    return kept.unionByName(made)


def e38_plannable(spark, sf_dir):
    """Plans go on if recommended and four fifths of the target, rounded half to even, are supported."""
    minutes = F.floor(F.col("o_totalprice") / 4000)
    can = (F.col("o_orderstatus") != "P") & (minutes >= half_even(F.lit(0.8) * (F.col("o_orderkey") % 60)))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("plans"), F.count_if(can).alias("plannable"))


def e39_objectives(spark, sf_dir):
    """Objectives of a plan must come once and in order; the claims that they name must be known."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 12).alias("objective"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "objective")
    marked = lines.withColumns({"back": F.coalesce(F.col("objective") < F.lag("objective").over(w), F.lit(False)), "times": F.count("*").over(Window.partitionBy("l_orderkey", "objective"))})
    known = marked.join(cells(spark, sf_dir).where("tier < 3").select(F.col("cell").alias("l_partkey"), F.lit(1).alias("is_known")), "l_partkey", "left")
    return violations(known, {"out_of_order": F.col("back"), "repeated": F.col("times") > 1, "unknown_claim": F.col("is_known").isNull()}, "objective")


def e41_claim_scores(spark, sf_dir):
    """A weight by type, bonuses for confidence and terms, between 0 and 100."""
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in (("definition", 55), ("distinction", 60), ("example", 30), ("finding", 70)) for x in pair]), F.col("claim_type"))
    score = F.least(F.lit(100), F.greatest(F.lit(0), weight + F.floor(F.col("confidence") * 20) + F.when(F.col("term").isNotNull(), 10).otherwise(0) + F.least(F.lit(15), F.length("excerpt"))))
    return evidence(spark, sf_dir).groupBy("doc_id").agg(F.sum(score).alias("points"), F.max(score).alias("best"))


def e42_claim_seconds(spark, sf_dir):
    seconds = F.least(F.lit(600), 45 + F.least(F.lit(60), F.length("excerpt") * 2) + F.when(F.col("has_contrast"), 30).otherwise(0) + F.when(F.col("claim_type") == "example", 40).otherwise(0))
    return evidence(spark, sf_dir).groupBy("doc_id").agg(F.sum(seconds).alias("seconds"), F.max(seconds).alias("longest"))


def e44_context_blocks(spark, sf_dir, distance: int = 2):
    """Blocks at most two places from a block with a definition, themselves without one: a join on shifted places."""
    seeds = evidence(spark, sf_dir).where("claim_type = 'definition' and term is not null").select("doc_id", "idx")
    near = seeds.select("doc_id", F.explode(F.sequence(F.col("idx") - distance, F.col("idx") + distance)).alias("idx")).distinct()
    found = blocks(spark, sf_dir).select("doc_id", "idx").join(near, ["doc_id", "idx"], "left_semi").join(seeds, ["doc_id", "idx"], "left_anti")
    return found.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum("idx").alias("idx_sum"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "e" and name[1:3].isdigit()}

WS = r"[ \t\n\x0B\f\r]+"
TOKENS = f"(CASE WHEN length(trim(regexp_replace(text, '{WS}', ' ', 'g'))) = 0 THEN 0 ELSE greatest(1, ceil(length(trim(regexp_replace(text, '{WS}', ' ', 'g'))) / 3.5)) END)::BIGINT"
FAULT = "CASE WHEN claim_type = 'definition' AND term IS NULL THEN 'no_term' WHEN claim_type = 'distinction' AND NOT has_contrast THEN 'no_contrast' END"
VALID = f"(length(excerpt) >= 12 AND contains(text, excerpt) AND ({FAULT}) IS NULL)"
NOTE = "regexp_matches(text, '^[0-9(|#]')"
ELIGIBLE = f"el AS (SELECT * FROM (SELECT *, {NOTE} AS note, bool_and({NOTE}) OVER (PARTITION BY doc_id) AS only_notes FROM blocks) WHERE NOT note OR only_notes)"
TARGETS = f"WITH {ELIGIBLE} SELECT doc_id, sum({TOKENS})::BIGINT AS total, least(sum({TOKENS}), ceil(sum({TOKENS})::DOUBLE * {{coverage}}::DOUBLE * 1.1::DOUBLE), 3000)::BIGINT AS target FROM el GROUP BY 1"
_SAME = " AND ".join(f"{n} IS NOT DISTINCT FROM was_{n}" for n in PROFILE[1:])
_LAGS = ", ".join(f"lag({n}) OVER w AS was_{n}" for n in PROFILE)
SUCCESSIVE = f"""so AS (SELECT *, {_LAGS}, row_number() OVER w > 1 AS known FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderkey % 3 AS depth,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 END AS mode, o_orderkey % 5 AS tier FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""
_FIRST = "CASE " + " ".join(f"WHEN {n} IS DISTINCT FROM was_{n} THEN '{n.removeprefix('o_order')}'" for n in PROFILE) + " END"


def kinds(source: str, rules: dict[str, str], *keys: str) -> str:
    columns = "".join(f"{k}, " for k in keys)
    return " UNION ALL ".join(f"SELECT {columns}'{kind}' AS kind, count(*) AS n FROM ({source}) WHERE {rule} {'GROUP BY ' + ', '.join(keys) if keys else 'HAVING count(*) > 0'}" for kind, rule in rules.items())


def packed(source: str, most: int) -> str:
    """Greedy bins in order: a bin ends before the item that would pass ``most`` and once it has ``most``."""
    return f"""WITH RECURSIVE it AS (SELECT doc_id, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS r FROM ({source})), p AS (
        SELECT doc_id, r, tokens AS held, 0 AS bin, tokens FROM it WHERE r = 1
        UNION ALL SELECT it.doc_id, it.r, CASE WHEN p.held > 0 AND (p.held + it.tokens > {most} OR p.held >= {most}) THEN it.tokens ELSE p.held + it.tokens END,
            CASE WHEN p.held > 0 AND (p.held + it.tokens > {most} OR p.held >= {most}) THEN p.bin + 1 ELSE p.bin END, it.tokens FROM p JOIN it ON it.doc_id = p.doc_id AND it.r = p.r + 1)"""


SQL = {
    "e05_evidence_violations": kinds(
        "SELECT *, count(*) OVER (PARTITION BY doc_id, evidence_id) AS same_id FROM evidence",
        {"repeated_id": "same_id > 1", "short_excerpt": "length(excerpt) < 12", "not_in_block": "NOT contains(text, excerpt)", "outside_block": "page_start > page OR page_end < page"}, "doc_id",
    ),
    "e06_collection_audit": """WITH m AS (SELECT b.doc_id, count(*) AS n FROM blocks b ANTI JOIN evidence e ON b.doc_id = e.doc_id AND b.idx = e.idx GROUP BY 1),
        s AS (SELECT evidence_id FROM evidence GROUP BY 1 HAVING count(DISTINCT doc_id) > 1), r AS (SELECT doc_id, count(*) AS n FROM evidence SEMI JOIN s USING (evidence_id) GROUP BY 1)
        SELECT doc_id, coalesce(m.n, 0) AS missing_blocks, coalesce(r.n, 0) AS shared_ids FROM m FULL JOIN r USING (doc_id)""",
    "e07_locators": kinds("SELECT * FROM evidence", {"order": "page_end < page_start", "beyond": "page_end > page", "before": "page_start < page"}, "source"),
    "e08_draft_rules": kinds("SELECT doc_id, page, count(*) AS c, count(DISTINCT claim) AS t FROM evidence GROUP BY 1, 2", {"repeated_claim": "t < c", "over_budget": "c > 3"}, "doc_id"),
    "e09_type_fields": f"SELECT source, {FAULT} AS fault, count(*) AS n FROM evidence WHERE ({FAULT}) IS NOT NULL GROUP BY ALL",
    "e10_salvaged_drafts": f"""WITH f AS (SELECT doc_id, page, claim, min(idx) AS idx FROM evidence WHERE {VALID} GROUP BY ALL), k AS (SELECT doc_id, page, count(*) AS kept, sum(idx)::BIGINT AS idx_sum FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS r FROM f) WHERE r <= 2 GROUP BY 1, 2), d AS (SELECT doc_id, page, count(*) AS drafts FROM evidence GROUP BY 1, 2)
        SELECT doc_id, page, drafts, coalesce(kept, 0) AS kept, coalesce(idx_sum, 0) AS idx_sum FROM d LEFT JOIN k USING (doc_id, page)""",
    "e11_sibling_excerpts": """SELECT e.doc_id, CASE WHEN contains(e.text, excerpt) THEN 'own' WHEN coalesce(contains(b.text, excerpt), false) THEN 'sibling' ELSE 'nowhere' END AS place, count(*) AS n
        FROM evidence e LEFT JOIN blocks b ON b.doc_id = e.doc_id AND b.idx = e.idx + 1 GROUP BY 1, 2""",
    "e12_merged_claims": """WITH p AS (SELECT doc_id, claim FROM evidence WHERE page % 2 = 1), a AS (SELECT DISTINCT doc_id, claim FROM evidence WHERE page % 2 = 0 AND (doc_id, claim) NOT IN (SELECT doc_id, claim FROM p))
        SELECT doc_id, 'prior' AS origin, count(*) AS claims FROM p GROUP BY 1 UNION ALL SELECT doc_id, 'added', count(*) FROM a GROUP BY 1""",
    "e14_extraction_units": packed(f"SELECT doc_id, idx, {TOKENS} AS tokens FROM blocks", 400) + ", u AS (SELECT doc_id, bin, sum(tokens)::BIGINT AS tokens FROM p GROUP BY 1, 2) SELECT doc_id, count(*) AS units, max(tokens) AS largest FROM u GROUP BY 1",
    "e15_evidence_ids": """WITH k AS (SELECT doc_id, 'ev-' || substring(sha256(concat_ws(chr(31), doc_id::VARCHAR, idx::VARCHAR, claim, excerpt)), 1, 16) AS key FROM evidence)
        SELECT doc_id, count(DISTINCT key) AS ids, min(key) AS least, max(key) AS greatest FROM k GROUP BY 1""",
    "e16_circuit_breaker": f"""WITH g AS (SELECT doc_id, min(idx) AS f FROM evidence WHERE {VALID} GROUP BY 1)
        SELECT doc_id, count(*) FILTER (f IS NULL OR idx < f) AS skipped, count(*) FILTER (f IS NULL OR idx < f) >= 3 AS aborts FROM evidence LEFT JOIN g USING (doc_id) GROUP BY 1""",
    "e17_profiles": """SELECT tier, briefs, [0.15, 0.35, 0.6, 1.0][tier]::DOUBLE AS coverage, [2, 3, 4, 6][tier] AS claims, [0, 1, 1, 2][tier] AS neighbours FROM (
        SELECT CASE WHEN o_orderkey % 130 <= 10 THEN 1 WHEN o_orderkey % 130 <= 30 THEN 2 WHEN o_orderkey % 130 <= 60 THEN 3 ELSE 4 END AS tier, count(*) AS briefs FROM orders GROUP BY 1)""",
    "e18_eligible_blocks": f"WITH {ELIGIBLE} SELECT doc_id, count(*) AS blocks, max(only_notes) AS only_notes, sum(idx)::BIGINT AS idx_sum FROM el GROUP BY 1",
    "e19_note_like": f"SELECT doc_id, count(*) FILTER ({NOTE}) AS note_lines, count(*) FILTER ({NOTE}) >= 2 AS note_like FROM blocks GROUP BY 1",
    "e21_target_tokens": TARGETS.format(coverage=0.35),
    "e23_exhaustive": f"SELECT doc_id, target >= total AS exhaustive FROM ({TARGETS.format(coverage=0.9)})",
    "e24_cell_batches": """WITH l AS (SELECT l_orderkey, min(l_partkey) AS cell, sum(floor(l_quantity))::BIGINT AS tokens FROM lineitem GROUP BY 1)
        SELECT cell, count(*) AS blocks, sum(tokens)::BIGINT AS tokens, ceil(sum(tokens) / 120)::BIGINT AS batches FROM l GROUP BY 1""",
    "e25_section_seeds": """WITH r AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM blocks), s AS (SELECT doc_id, run, min(idx) AS seed FROM r WHERE run > 0 AND NOT is_heading GROUP BY 1, 2)
        SELECT doc_id, count(DISTINCT seed) AS seeds, sum(seed)::BIGINT AS seed_sum FROM s GROUP BY 1""",
    "e26_serialised_batches": packed("SELECT doc_id, idx, length(excerpt) + length(claim) AS tokens FROM evidence", 600) + " SELECT doc_id, count(*)::INT AS items, max(bin) + 1 AS batches FROM p GROUP BY 1",
    "e28_merge_groups": "SELECT 'not_disjoint' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1) UNION ALL "
    + kinds("SELECT l_orderkey, count(DISTINCT l_returnflag) AS types, max(l_suppkey) AS canonical, list(l_partkey) AS members FROM lineitem GROUP BY 1", {"several_types": "types > 1", "canonical_outside": "NOT list_contains(members, canonical)"}),
    "e30_ledger": "SELECT md5(claim) AS claim_md5, count(*) AS items, count(DISTINCT doc_id) AS sources, max(confidence)::DOUBLE AS best FROM evidence GROUP BY claim HAVING count(*) > 1",
    "e31_passthrough": "SELECT source, CASE WHEN claim_type = 'example' THEN 'moderate' WHEN confidence >= 0.75 THEN 'strong' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'uncertain' END AS support, count(*) AS claims FROM evidence GROUP BY ALL",
    "e33_claim_ids": """WITH c AS (SELECT doc_id, claim, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS ids FROM evidence GROUP BY 1, 2)
        SELECT doc_id, count(*) AS claims, min('clm-' || substring(sha256(concat_ws(chr(31), doc_id::VARCHAR, claim, ids)), 1, 16)) AS least FROM c GROUP BY 1""",
    "e36_compatible_profiles": f"WITH {SUCCESSIVE} SELECT o_orderstatus, count(*) AS pairs, count(*) FILTER ({_SAME}) AS compatible FROM so WHERE known GROUP BY 1",
    "e61_reuse_reasons": f"WITH {SUCCESSIVE} SELECT CASE WHEN NOT known THEN 'absent' ELSE coalesce({_FIRST}, 'hit') END AS reason, count(*) AS plans FROM so GROUP BY 1",
    "e79_reused_plans": f"""WITH {SUCCESSIVE} SELECT o_orderpriority, CASE WHEN o_orderpriority IS DISTINCT FROM was_o_orderpriority THEN 'redo' WHEN o_orderkey % 100 >= 40 THEN 'continue' ELSE 'stop' END AS verdict,
        count(*) AS plans FROM so WHERE known GROUP BY ALL""",
    "e80_miss_reasons": f"""WITH {SUCCESSIVE}, r AS (SELECT o_custkey, coalesce({_FIRST}, 'reuse') AS reason FROM so WHERE known)
        SELECT o_custkey, count(*) FILTER (reason = 'reuse') AS reused, min(reason) AS first_reason, count(*) AS plans FROM r GROUP BY 1""",
    "e81_carried_forward": """WITH o AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N'), n AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'N')
        SELECT 'carried' AS state, count(*) AS blocks FROM n SEMI JOIN o USING (l_orderkey, l_suppkey) UNION ALL SELECT 'redone', count(*) FROM n ANTI JOIN o USING (l_orderkey, l_suppkey)""",
    "e38_plannable": "SELECT o_orderpriority, count(*) AS plans, count(*) FILTER (o_orderstatus <> 'P' AND floor(o_totalprice / 4000) >= round_even(0.8 * (o_orderkey % 60), 0)) AS plannable FROM orders GROUP BY 1",
    "e39_objectives": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 12 AS objective FROM lineitem), m AS (SELECT *, coalesce(objective < lag(objective) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, objective), false) AS back, count(*) OVER (PARTITION BY l_orderkey, objective) AS times, l_partkey IN (SELECT cell FROM cells WHERE tier < 3) AS known FROM l) "
    + kinds("SELECT * FROM m", {"out_of_order": "back", "repeated": "times > 1", "unknown_claim": "NOT known"}, "objective"),
    "e41_claim_scores": """WITH s AS (SELECT doc_id, least(100, greatest(0, CASE claim_type WHEN 'definition' THEN 55 WHEN 'distinction' THEN 60 WHEN 'example' THEN 30 ELSE 70 END + floor(confidence * 20)
        + CASE WHEN term IS NOT NULL THEN 10 ELSE 0 END + least(15, length(excerpt))))::BIGINT AS s FROM evidence) SELECT doc_id, sum(s)::BIGINT AS points, max(s) AS best FROM s GROUP BY 1""",
    "e42_claim_seconds": """WITH s AS (SELECT doc_id, least(600, 45 + least(60, length(excerpt) * 2) + CASE WHEN has_contrast THEN 30 ELSE 0 END + CASE WHEN claim_type = 'example' THEN 40 ELSE 0 END)::INT AS s FROM evidence)
        SELECT doc_id, sum(s)::BIGINT AS seconds, max(s) AS longest FROM s GROUP BY 1""",
    "e44_context_blocks": """WITH s AS (SELECT doc_id, idx FROM evidence WHERE claim_type = 'definition' AND term IS NOT NULL), n AS (SELECT DISTINCT doc_id, idx + d AS idx FROM s, generate_series(-2, 2) AS g(d))
        SELECT doc_id, count(*) AS blocks, sum(idx)::BIGINT AS idx_sum FROM (SELECT doc_id, idx FROM blocks SEMI JOIN n USING (doc_id, idx)) ANTI JOIN s USING (doc_id, idx) GROUP BY 1""",
}
