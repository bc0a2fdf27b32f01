"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

The tree is domain, language, source. A budget of tokens is poured from the root: children share it by weight, none
gets more than its subtree can give (its tokens times max_epochs), and what one cannot take its siblings take by
weight before anything returns to their parent. A leaf then gives whole epochs of its documents and the token-prefix
of one more, in an order seeded by leaf epoch and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibra.llm.common import WORD, saved, table

LEAF = ["domain", "lang", "source"]
#: Documents of a leaf that share a bucket of the seeded order, about.
BUCKET_ROWS = 4096
#: Production weights; any name that is not listed has weight 1.
DOMAINS = 4
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}}


def words(text: Column) -> Column:
    """Tokens of a text for budgets: its words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch's order: 60 bits."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def pour(nodes: DataFrame, parent: list[str], name: str, budget: str, w: str, capacity: str, out: str) -> DataFrame:
    """Shares each parent's budget among its children by weight, none above its capacity.

    With children in order of capacity for a unit of weight, the level is (budget - capacities of those before) /
    (weights from here on) at the first child that this level does not fill; children before it are full.
    """
    ratio = F.when(F.col(w) > 0, F.col(capacity) / F.greatest(F.col(w), F.lit(1)))
    order = Window.partitionBy(*parent).orderBy("_ratio", name)
    nodes = nodes.withColumn("_ratio", F.coalesce(ratio, F.lit(-1.0)))
    before = F.coalesce(F.sum(F.when(F.col(w) > 0, F.col(capacity)).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(w).over(order.rowsBetween(0, Window.unboundedFollowing))
    nodes = nodes.withColumn("_level", F.when(F.col(w) > 0, (F.col(budget) - before) / F.greatest(left, F.lit(1))))
    level = F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(Window.partitionBy(*parent))
    full = F.when(F.col(w) > 0, F.col(capacity).cast("double")).otherwise(F.lit(0.0))
    nodes = nodes.withColumn("_l", level)
    return nodes.withColumn(out, F.when(F.col("_l").isNull(), full).otherwise(F.least(full, F.col("_l") * F.col(w)))).drop("_ratio", "_level", "_l")


def leaf_targets(rows: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int) -> DataFrame:
    """A row for each leaf: docs, supply, target, whole epochs, and the tokens to take of one more."""
    leaves = rows.groupBy(*LEAF).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("supply"))
    leaves = leaves.withColumns({f"w_{c}": weight(c, weights.get(c, {})) for c in LEAF})
    leaves = leaves.withColumn("capacity", F.when(F.col("w_source") > 0, F.col("supply") * max_epochs).otherwise(0))
    langs = leaves.groupBy("domain", "lang", "w_domain", "w_lang").agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain", "w_domain").agg(F.sum(F.when(F.col("w_lang") > 0, F.col("capacity")).otherwise(0)).alias("capacity"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("budget", F.floor(F.sum("supply").over(Window.partitionBy()) * share).cast("double"))
    domains = pour(domains, [], "domain", "budget", "w_domain", "capacity", "domain_budget")
    langs = langs.drop("supply").join(domains.select("domain", "domain_budget"), "domain")
    langs = pour(langs, ["domain"], "lang", "domain_budget", "w_lang", "capacity", "lang_budget")
    leaves = leaves.join(langs.select("domain", "lang", "lang_budget"), ["domain", "lang"])
    leaves = pour(leaves, ["domain", "lang"], "source", "lang_budget", "w_source", "capacity", "target")
    target = F.floor(F.col("target") + 1e-6).cast("long")
    full = F.when(F.col("supply") > 0, F.floor(F.col("t") / F.greatest(F.col("supply"), F.lit(1)))).otherwise(0).cast("int")
    return (
        leaves.withColumn("t", target)
        .withColumn("epochs", full)
        .select(*LEAF, "docs", "supply", F.col("t").alias("target"), "epochs", (F.col("t") - F.col("epochs") * F.col("supply")).alias("rest"))
    )


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int, domain: Column | None = None) -> DataFrame:
    """docs with domain, n_tokens, epoch and take_tokens: a row for each time that a document is taken.

    docs has doc_id, text, lang and source; its other columns are kept but for those four names and names that begin
    with _mix. domain defaults to a column of that name, or else one of DOMAINS names by the source's CRC. Null
    lang or source is the leaf 'unknown'. Documents without words are taken with each whole epoch. take_tokens is
    n_tokens but for the last document of a prefix, which ends the budget exactly. Equal rows are taken one by one.
    An empty table gives no rows. The budget is `share` of all tokens.

    Only the bucket of the seeded order in which a leaf's prefix ends is sorted; for all other documents the leaf's
    numbers decide. A leaf's buckets hold about BUCKET_ROWS documents each, so a hot source is many buckets.
    """
    extra = [c for c in docs.columns if c not in ("domain", "n_tokens", "epoch", "take_tokens") and not c.startswith("_mix")]
    if domain is None:
        domain = F.col("domain") if "domain" in docs.columns else F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(DOMAINS)).cast("string"))
    rows = docs.select(*extra, F.coalesce(domain, F.lit("unknown")).alias("domain"), words(F.col("text")).alias("n_tokens"))
    keys = {"_mix_lang": F.coalesce("lang", F.lit("unknown")), "_mix_source": F.coalesce("source", F.lit("unknown"))}
    narrow = rows.select("doc_id", "domain", keys["_mix_lang"].alias("lang"), keys["_mix_source"].alias("source"), "n_tokens")
    targets = saved(leaf_targets(narrow, weights, share, max_epochs), "mix-targets")
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS)).cast("long")
    targets = targets.withColumn("buckets", buckets)
    place = seeded(seed, F.col("epochs"), F.col("doc_id"))
    bucket = F.shiftright(F.shiftright(F.col("_mix_at"), 30) * F.col("buckets"), 30)

    sums = narrow.join(targets.filter("rest > 0"), LEAF).withColumn("_mix_at", place).withColumn("bucket", bucket)
    sums = sums.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("upto", upto).join(targets.select(*LEAF, "rest"), LEAF)
    ends = saved(sums.filter("upto - tokens < rest and rest <= upto").groupBy(*LEAF).agg(F.min("bucket").alias("end"), F.min(F.col("upto") - F.col("tokens")).alias("base")), "mix-ends")

    plan = targets.join(ends, LEAF, "left").select(F.col("domain"), F.col("lang").alias("_mix_lang"), F.col("source").alias("_mix_source"), "epochs", "rest", "buckets", "end", "base")
    placed = rows.withColumns(keys).join(plan, ["domain", "_mix_lang", "_mix_source"]).withColumn("_mix_at", place).withColumn("_mix_bucket", bucket)
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs") - 1)).otherwise(F.array().cast("array<int>"))
    taken = F.when(F.col("_mix_bucket") < F.col("end"), F.concat(whole, F.array("epochs"))).otherwise(whole)
    out = [*extra, "domain", "n_tokens"]
    sure = placed.select(*out, F.explode(taken).alias("epoch"), F.col("n_tokens").alias("take_tokens"))
    order = Window.partitionBy("domain", "_mix_lang", "_mix_source").orderBy("_mix_at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.filter(F.col("_mix_bucket") == F.col("end")).withColumn("_mix_before", F.col("base") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    last = last.filter(F.col("_mix_before") < F.col("rest"))
    return sure.unionByName(last.select(*out, F.col("epochs").alias("epoch"), F.least(F.col("n_tokens"), F.col("rest") - F.col("_mix_before")).alias("take_tokens")))


SEED, SHARE, MAX_EPOCHS = 20, 0.75, 3


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs, WEIGHTS, SHARE, MAX_EPOCHS, SEED).drop("text")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _pour_sql(src: str, parent: str, name: str, budget: str, w: str, out: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""SELECT * EXCLUDE (ratio, level), CASE WHEN max(CASE WHEN level <= ratio THEN level END) OVER ({by}) IS NULL
        THEN CASE WHEN {w} > 0 THEN capacity::DOUBLE ELSE 0 END
        ELSE least(CASE WHEN {w} > 0 THEN capacity::DOUBLE ELSE 0 END, max(CASE WHEN level <= ratio THEN level END) OVER ({by}) * {w}) END AS {out}
      FROM (SELECT *, CASE WHEN {w} > 0 THEN ({budget} - coalesce(sum(CASE WHEN {w} > 0 THEN capacity ELSE 0 END) OVER ({by} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / sum({w}) OVER ({by} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE END AS level
        FROM (SELECT *, CASE WHEN {w} > 0 THEN capacity::DOUBLE / {w} ELSE -1 END AS ratio FROM {src}))"""


def mix_sql(weights: dict[str, dict[str, int]], share: float, max_epochs: int, seed: int) -> str:
    """The same rows in DuckDB, with one running sum over each whole leaf. The domain of a source is looked up."""
    return f"""
    WITH docs AS (SELECT doc_id, 'd' || (CASE source {_domains_sql()} END) AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        lang AS lang0, source AS source0, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
    leaf0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, {_case('domain', weights['domain'])} AS w_domain, {_case('lang', weights['lang'])} AS w_lang,
        {_case('source', weights['source'])} AS w_source, (sum(n_tokens) * {max_epochs})::BIGINT AS capacity FROM docs GROUP BY domain, lang, source),
    lang0 AS (SELECT domain, lang, w_domain, w_lang, sum(capacity)::BIGINT AS capacity, sum(supply)::BIGINT AS supply FROM leaf0 GROUP BY ALL),
    dom0 AS (SELECT domain, w_domain, sum(capacity)::BIGINT AS capacity, floor(sum(sum(supply)) OVER () * {share}::DOUBLE) AS budget FROM lang0 GROUP BY domain, w_domain),
    dom1 AS ({_pour_sql('dom0', '', 'domain', 'budget', 'w_domain', 'domain_budget')}),
    lang1 AS (SELECT l.*, d.domain_budget FROM lang0 l JOIN dom1 d USING (domain)),
    lang2 AS ({_pour_sql('lang1', 'domain', 'lang', 'domain_budget', 'w_lang', 'lang_budget')}),
    leaf1 AS (SELECT f.*, l.lang_budget FROM leaf0 f JOIN lang2 l USING (domain, lang)),
    leaf2 AS ({_pour_sql('leaf1', 'domain, lang', 'source', 'lang_budget', 'w_source', 'target')}),
    leaf3 AS (SELECT domain, lang, source, supply, floor(target + 1e-6)::BIGINT AS target, CASE WHEN supply > 0 THEN floor(floor(target + 1e-6) / supply) ELSE 0 END::INT AS epochs FROM leaf2),
    placed AS (SELECT d.*, f.epochs, f.target - f.epochs * f.supply AS rest,
        coalesce(sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY ('0x' || substr(md5('{seed}:' || f.epochs || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT, doc_id, n_tokens
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM docs d JOIN leaf3 f USING (domain, lang, source))
    SELECT doc_id, lang0 AS lang, source0 AS source, domain, n_tokens, e.epoch::INT AS epoch, n_tokens AS take_tokens FROM placed, LATERAL (SELECT unnest(range(epochs)) AS epoch) e
    UNION ALL
    SELECT doc_id, lang0, source0, domain, n_tokens, epochs, least(n_tokens, rest - before)::BIGINT FROM placed WHERE rest > 0 AND before < rest"""


def _domains_sql() -> str:
    """DuckDB has no CRC, so the sources' domains are written out: src0 to src19, by rule."""
    import zlib

    return " ".join(f"WHEN 'src{i}' THEN '{zlib.crc32(f'src{i}'.encode()) % DOMAINS}'" for i in range(20)) + f" ELSE '{zlib.crc32(b'') % DOMAINS}'"


OP1_SQL = mix_sql(WEIGHTS, SHARE, MAX_EPOCHS, SEED)
