"""URL filters by rules and gradient-boosted trees on lexical features.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's; the longest fitting rule decides.  URLs under a rule are the labelled ones:
they train boosted trees (Spark ML) which judge all others.  The features are lengths, depth,
digit ratio, entropy of the characters, number of parameters, and statistics of the suffixes
(the host's last label, last two labels and the host itself): the order of magnitude of their share of all URLs.

A rule decides the labels of whole suffixes, so a suffix's block rate only gives the rule back, and told without the URL's own
rule it gives the opposite (measured: no URL of a rule left out was judged as the rule does).  Neither block rates nor
exact frequencies, which name a suffix as well, are therefore features.  ``held_out_accuracy`` measures by rule: each
rule's URLs judged by trees that saw none of them.

The trees are compiled into one column expression, so that judging a URL is part of the scan's
generated code.  Trees are fitted on at most ``TRAIN_ROWS`` labelled URLs (the smallest
hashes; a documented bound); suffix statistics count all URLs, by ``SLOTS`` hashes of the suffixes, so that their
tables have one bounded size and are always broadcast.

Defined results: a null URL or one without ``://`` has an empty host and path and is judged by
the trees alone; labels of one kind only give that verdict, none at all ``allow``; repeated rows
each get theirs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.trees import trees_of, value

#: The rules of the production query as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

TRAIN_ROWS = 20_000
TREES, DEPTH = 10, 3
SLOTS = 1 << 16  # hashes that suffixes are counted by
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&%#:"

FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters", "f_dashes", "f_last_share", "f_two_share", "f_host_share"]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(url, instr(url, '://') + 3)"), "#", 1)).otherwise(F.lit(""))
    bare = F.coalesce(F.substring_index(after, "?", 1), F.lit(""))
    host = F.substring_index(bare, "/", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.substring(bare, F.length(host) + 1, F.length(bare))


def fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def by_rules(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in longest])
    verdict = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in longest])
    return rule, verdict


def _lexical(urls: DataFrame) -> DataFrame:
    u = F.lower(F.coalesce(F.col("url"), F.lit("")))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda c: F.length(u) - F.length(F.replace(u, F.lit(c), F.lit("")))
    share = lambda c: count(c) / n
    entropy = reduce(lambda a, b: a + b, [F.when(count(c) > 0, -share(c) * F.log2(share(c))).otherwise(0.0) for c in ALPHABET])
    slashes = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    features = {
        "f_length": F.length(u),
        "f_host_length": F.length("host"),
        "f_path_length": F.length("path"),
        "f_depth": slashes,
        "f_labels": F.size(F.split("host", r"\.")),
        "f_digits": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
        "f_entropy": entropy,
        "f_parameters": F.when(F.instr(u, "?") > 0, count("&") + 1).otherwise(0),
        "f_dashes": count("-"),
    }
    named = urls.withColumns({k: v.cast("double") for k, v in features.items()})
    return named.withColumns({"last_label": F.substring_index("host", ".", -1), "two_labels": F.substring_index("host", ".", -2)})


def _with_suffixes(urls: DataFrame) -> DataFrame:
    """Adds the orders of magnitude of the suffixes' shares of all URLs."""
    total = None
    for key, name in (("last_label", "f_last_share"), ("two_labels", "f_two_share"), ("host", "f_host_share")):
        slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
        counts = materialise(urls.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 1 if total is None else total
        urls = urls.withColumn("slot", slot).join(F.broadcast(counts), "slot").withColumn(name, F.floor(F.log10(F.col("n") / total)).cast("double")).drop("slot", "n")
    return urls


def _score(sample: DataFrame) -> Column:
    """Block score of a URL's features by trees fitted on ``sample`` (label and features)."""
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return F.lit(kinds[0] if kinds else 0.0)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.repartition(4)).select("label", "features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=64).fit(vectors)
    margin = reduce(lambda a, b: a + b, [F.lit(float(w)) * value(t) for w, t in zip(model.treeWeights, trees_of(model, FEATURES))])
    return 1 / (1 + F.exp(-2 * margin))


def described(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, by_rule, label and the features of each page."""
    host, path = parts(F.col("url"))
    rule, verdict = by_rules(rules)
    urls = _lexical(pages.select("page_id", "url").withColumn("host", host).withColumn("path", path))
    urls = urls.withColumns({"rule": rule, "by_rule": verdict}).withColumn("label", F.when(F.col("by_rule") == "block", 1.0).when(F.col("by_rule") == "allow", 0.0))
    return _with_suffixes(urls)


def _sample(urls: DataFrame) -> DataFrame:
    return materialise(urls.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS).select("rule", "label", *FEATURES))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, block_score."""
    urls = described(pages, rules)
    scored = urls.withColumn("block_score", _score(_sample(urls)))
    by_score = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_score).alias("verdict"), "block_score")


def held_out_accuracy(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> dict[str, float]:
    """For each rule the share of its URLs that trees fitted on the other rules' URLs judge as it does."""
    sample = _sample(described(pages, rules))
    out = {}
    for verdict, host, path in rules:
        mine = F.col("rule") == host + path
        right = (_score(sample.where(~mine)) >= 0.5) == F.lit(verdict == "block")
        out[host + path] = sample.where(mine).agg(F.avg(right.cast("double"))).first()[0]
    return out
