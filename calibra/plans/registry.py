"""Every query of the library over the star schema, with DuckDB SQL that says the same another way.

The SQL is written independently where it matters: it matches again at each threshold, compares all pairs of hashes,
counts pairs for the AUC and walks predictions one rank at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.functions import geometry as P
from calibra.functions import scalars as S
from calibra.operators import gates as G
from calibra.operators import matching as M
from calibra.operators import near_dup as N
from calibra.operators import rules as R
from calibra.operators import sessions as T
from calibra.operators import statistics as X
from calibra.plans import fixtures as fx
from calibra.plans.fixtures import frame, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Thresholds of the two runs, and bits within which hashes of 64 bits are near.
AT, AT_A, NEAR_BITS = 0.3, 0.35, 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(fx.NAMES)], "cls string, ord int")


def _partners(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(fx.PARTNERS.items()), "cls string, partner string")


def _run(spark: SparkSession, sf: str, pred: str = fx.PRED, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """images of a split, truth boxes, and predictions matched without a cut."""
    images = frame(spark, sf, fx.IMAGES).filter(F.col("split") == split)
    gt = frame(spark, sf, fx.GT).join(images, "image", "left_semi")
    return images, gt, M.match(gt, frame(spark, sf, pred).join(images, "image", "left_semi"))


# One prediction is taken at each step, by rank; `used` is what its image's earlier ones took.
_IOU = "CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - inter > 0 THEN inter / ({a}.w * {a}.h + {b}.w * {b}.h - inter) ELSE 0 END"
_INTER = "greatest(0.0::DOUBLE, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0::DOUBLE, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


def _walk(name: str, gt: str, pred: str, keys: str = "image", cut: str = "") -> str:
    on = " AND ".join(f"p.{k} = g.{k}" for k in keys.split(", "))
    part = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys}{', t' if cut else ''} ORDER BY conf DESC, pred_idx) AS rk FROM {f'(SELECT p.*, t FROM {pred} p, {cut} WHERE conf >= t)' if cut else pred}),
    {name}_cand AS (SELECT {part}{', p.t' if cut else ''}, p.rk, list(gt_idx ORDER BY iou DESC, gt_idx DESC) AS c FROM (SELECT p.*, g.gt_idx, {_IOU.format(a='p', b='g')} AS iou FROM (SELECT p.*, g.gt_idx AS gi, {_INTER.format(a='p', b='g')} AS inter FROM {name}_ranked p JOIN {gt} g ON {on}) p JOIN {gt} g ON {on} AND p.gi = g.gt_idx) p WHERE iou >= 0.5 GROUP BY ALL),
    {name}_walk AS (SELECT {keys}{', t' if cut else ''}, 0::BIGINT AS rk, []::BIGINT[] AS used, NULL::BIGINT AS took FROM (SELECT DISTINCT {keys}{', t' if cut else ''} FROM {name}_ranked)
      UNION ALL SELECT {', '.join('w.' + k for k in keys.split(', '))}{', w.t' if cut else ''}, p.rk, CASE WHEN len(f) > 0 THEN list_append(w.used, f[1]) ELSE w.used END, f[1] FROM
        (SELECT w.*, r.rk AS next, list_filter(coalesce(c.c, []), lambda v: NOT list_contains(w.used, v)) AS f FROM {name}_walk w JOIN {name}_ranked r ON {' AND '.join(f'w.{k} = r.{k}' for k in keys.split(', '))}{' AND w.t = r.t' if cut else ''} AND r.rk = w.rk + 1
         LEFT JOIN {name}_cand c ON {' AND '.join(f'c.{k} = r.{k}' for k in keys.split(', '))}{' AND c.t = r.t' if cut else ''} AND c.rk = r.rk) w JOIN (SELECT 1) one ON TRUE JOIN {name}_ranked p ON {' AND '.join(f'w.{k} = p.{k}' for k in keys.split(', '))}{' AND w.t = p.t' if cut else ''} AND p.rk = w.next),
    {name} AS (SELECT r.*, w.took FROM {name}_ranked r JOIN {name}_walk w ON {' AND '.join(f'w.{k} = r.{k}' for k in keys.split(', '))}{' AND w.t = r.t' if cut else ''} AND w.rk = r.rk)"""


def _part(split: str = "test", pred: str = fx.PRED, name: str = "") -> dict[str, str]:
    images = f"SELECT * FROM ({fx.IMAGES}) i WHERE split = '{split}'"
    return {f"images{name}": images, f"gt{name}": f"SELECT * FROM ({fx.GT}) g WHERE image IN (SELECT image FROM images{name})", f"pred{name}": f"SELECT * FROM ({pred}) p WHERE image IN (SELECT image FROM images{name})"}


def _cut(name: str, pred: str, t: float) -> str:
    return f"{name} AS (SELECT * FROM {pred} WHERE conf >= {t})"


def _table(name: str, m: str, gt: str) -> str:
    """Outcome table of a walked matching m."""
    return f"""{name} AS (SELECT truth, pred, count(*)::BIGINT AS n FROM (SELECT coalesce(g.cls, 'background') AS truth, m.cls AS pred FROM {m} m LEFT JOIN {gt} g ON g.image = m.image AND g.gt_idx = m.took
      UNION ALL SELECT g.cls, 'missed' FROM {gt} g WHERE NOT EXISTS (SELECT 1 FROM {m} m WHERE m.image = g.image AND m.took = g.gt_idx)) GROUP BY ALL)"""


_TEST = with_(**_part()) + ", " + _cut("cutp", "pred", AT) + ", " + _walk("m", "gt", "cutp") + ", " + _table("tab", "m", "gt")
_NAMES_SQL = "(SELECT unnest([" + ", ".join(f"'{n}'" for n in fx.NAMES) + "]) AS cls, unnest(range(11)) AS ord)"
_PARTNERS_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted(fx.PARTNERS.items())) + ") v(cls, partner))"


@query(with_(**_part()) + ", " + _walk("m", "gt", "pred") + " SELECT m.image, m.pred_idx, m.cls, m.conf, m.took AS gt_idx, g.cls AS true_cls FROM m LEFT JOIN gt g ON g.image = m.image AND g.gt_idx = m.took")
def greedy_match(spark, sf):
    return _run(spark, sf)[2]


@query(_TEST + " SELECT truth, pred, n FROM tab")
def outcome_table(spark, sf):
    return M.outcomes(*_run(spark, sf), AT)


@query(_TEST + " SELECT truth, map_from_entries(list((pred, n) ORDER BY pred))::VARCHAR AS pred FROM tab GROUP BY truth")
def confusion_map(spark, sf):
    m = M.confusion(M.outcomes(*_run(spark, sf), AT))
    return m.select("truth", F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("pred"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ", "), F.lit("}")).alias("pred"))


@query(f"""{_TEST} SELECT c.cls, coalesce(sum(n) FILTER (truth = c.cls), 0)::BIGINT AS n_gt, coalesce(sum(n) FILTER (pred = c.cls), 0)::BIGINT AS n_pred, coalesce(sum(n) FILTER (truth = c.cls AND pred = c.cls), 0)::BIGINT AS correct,
  round(coalesce(sum(n) FILTER (truth = c.cls AND pred = c.cls) / nullif(sum(n) FILTER (pred = c.cls), 0), 0), 6) AS precision, round(coalesce(sum(n) FILTER (truth = c.cls AND pred = c.cls) / nullif(sum(n) FILTER (truth = c.cls), 0), 0), 6) AS recall
  FROM {_NAMES_SQL} c LEFT JOIN tab ON truth = c.cls OR pred = c.cls GROUP BY c.cls""")
def per_class_pr(spark, sf):
    return rounded(M.per_class(M.outcomes(*_run(spark, sf), AT), _classes(spark)), "precision", "recall")


@query(f"{_TEST} SELECT round(2 * sum(n) FILTER (truth = pred) / (sum(n) FILTER (pred <> 'missed') + sum(n) FILTER (truth <> 'background')), 6) AS f1 FROM tab")
def micro_f1(spark, sf):
    return rounded(M.micro_f1(M.outcomes(*_run(spark, sf), AT)), "f1")


_SWEEP = with_(**_part("val"), grid="SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS t") + ", " + _walk("m", "gt", "pred", cut="grid")
_SWEEP += """, s AS (SELECT grid.t AS threshold, count(*) FILTER (m.cls = g.cls)::BIGINT AS correct, count(m.image)::BIGINT AS predicted, (SELECT count(*) FROM gt)::BIGINT AS actual
    FROM grid LEFT JOIN m ON m.t = grid.t LEFT JOIN gt g ON g.image = m.image AND g.gt_idx = m.took GROUP BY grid.t)"""


@query(_SWEEP + " SELECT threshold, correct, predicted, actual, round(coalesce(2 * correct / nullif(predicted + actual, 0), 0), 6) AS f1 FROM s")
def threshold_sweep(spark, sf):
    return rounded(M.sweep(*_run(spark, sf, split="val")), "f1")


@query(_SWEEP + " SELECT threshold, round(2 * correct / (predicted + actual), 6) AS f1 FROM s ORDER BY 2 * correct / (predicted + actual) DESC, threshold LIMIT 1")
def threshold_choice(spark, sf):
    return rounded(M.best_threshold(M.sweep(*_run(spark, sf, split="val"))), "f1")


def _wilson_sql(k: str, n: str) -> str:
    p, nn = f"({k} / {n}::DOUBLE)", f"{n}::DOUBLE"
    half = f"1.96 * sqrt({p} * (1 - {p}) / {nn} + 1.96 * 1.96 / (4 * {nn} * {nn})) / (1 + 1.96 * 1.96 / {nn})"
    mid = f"({p} + 1.96 * 1.96 / (2 * {nn})) / (1 + 1.96 * 1.96 / {nn})"
    return f"CASE WHEN {n} > 0 THEN round(greatest(0, {mid} - {half}), 6) ELSE 0 END AS low, CASE WHEN {n} > 0 THEN round(least(1, {mid} + {half}), 6) ELSE 0 END AS high"


_ERRORS = f"""e AS (SELECT p.cls, p.partner, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(n) FILTER (pred = p.cls), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (pred = p.partner), 0)::BIGINT AS confused,
  coalesce(sum(n) FILTER (pred NOT IN (p.cls, p.partner, 'missed')), 0)::BIGINT AS other, coalesce(sum(n) FILTER (pred = 'missed'), 0)::BIGINT AS missed FROM {_PARTNERS_SQL} p LEFT JOIN {{t}} ON truth = p.cls GROUP BY p.cls, p.partner)"""


@query(f"{_TEST}, {_ERRORS.format(t='tab')} SELECT *, round(CASE WHEN n > 0 THEN confused / n ELSE 0 END, 6) AS share, {_wilson_sql('confused', 'n')} FROM e")
def error_breakdown(spark, sf):
    return rounded(M.errors(M.outcomes(*_run(spark, sf), AT), _partners(spark)), "share", "low", "high")


_SUSPECTS, _CONTROLS = ["k00", "k02"], ["k04", "k06", "k08"]
_VERDICT = with_(**_part(), **_part("val", name="v")) + ", " + _cut("cutp", "pred", AT) + ", " + _walk("m", "gt", "cutp") + ", " + _table("tab", "m", "gt") + ", " + _cut("cutv", "predv", AT) + ", " + _walk("mv", "gtv", "cutv") + ", " + _table("tabv", "mv", "gtv")


@query(f"""{_VERDICT}, {_ERRORS.format(t='tab')}, ev AS (SELECT * FROM ({_ERRORS.format(t='tabv').removeprefix('e AS ')})),
  s AS (SELECT e.confused > greatest(e.other, e.missed) AND e.confused / e.n > (SELECT max(confused / n) FROM e WHERE cls IN ('k04', 'k06', 'k08')) AND e.confused / e.n > ev.confused / ev.n AS good, e.missed > greatest(e.confused, e.other) AS gone FROM e JOIN ev USING (cls) WHERE cls IN ('k00', 'k02'))
  SELECT CASE WHEN bool_and(good) THEN 'supported' WHEN bool_and(gone) THEN 'rejected' ELSE 'mixed' END AS verdict FROM s""")
def confusion_verdict(spark, sf):
    test, val = (M.errors(M.outcomes(*_run(spark, sf, split=s), AT), _partners(spark)) for s in ("test", "val"))
    return R.confusion_verdict(test, val, _SUSPECTS, _CONTROLS)


_AP_BODY = _walk("m", "gt", "pred", keys="image, cls") + """,
  r AS (SELECT cls, count(*) FILTER (took IS NOT NULL) OVER w AS tp, row_number() OVER w AS k FROM m WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, image, pred_idx ROWS UNBOUNDED PRECEDING)),
  ng AS (SELECT cls, count(*)::BIGINT AS n_gt FROM gt GROUP BY cls), pr AS (SELECT r.cls, tp / n_gt AS rec, tp / k AS prec FROM r JOIN ng USING (cls)),
  ap AS (SELECT ng.cls, n_gt, avg(coalesce((SELECT max(prec) FROM pr WHERE pr.cls = ng.cls AND rec >= i / 100.0::DOUBLE), 0)) AS ap FROM ng, range(101) g(i) GROUP BY ng.cls, n_gt)"""
_AP = with_(**_part()) + ", " + _AP_BODY


@query(_AP + " SELECT cls, n_gt, round(ap, 6) AS ap FROM ap")
def ap50(spark, sf):
    images, gt, _ = _run(spark, sf)
    return rounded(M.average_precision(gt, frame(spark, sf, fx.PRED).join(images, "image", "left_semi")), "ap")


@query(_AP + " SELECT round(avg(ap), 6) AS map FROM ap")
def map50(spark, sf):
    return rounded(M.mean_average_precision(ap50(spark, sf)), "map")


# Boxes of one class and how the two runs read them.
_FATE = "CASE WHEN p.cls = 'k00' THEN 'correct' WHEN p.cls = 'k01' THEN 'misread' WHEN p.cls IS NULL THEN 'missed' ELSE 'other' END"
_RUNS = with_(**_part(), preda=f"SELECT * FROM ({fx.PRED_A}) p WHERE image IN (SELECT image FROM images)") + ", " + _cut("cutc", "pred", AT) + ", " + _walk("mc", "gt", "cutc") + ", " + _cut("cuta", "preda", AT_A) + ", " + _walk("ma", "gt", "cuta")
_RUNS += "".join(f", f{r} AS (SELECT g.image, g.gt_idx, {_FATE} AS fate FROM gt g LEFT JOIN m{r} p ON p.image = g.image AND p.took = g.gt_idx WHERE g.cls = 'k00')" for r in "ca")


def _fates(spark, sf, pred, threshold):
    _, gt, matched = _run(spark, sf, pred)
    hits = matched.filter((F.col("conf") >= threshold) & F.col("gt_idx").isNotNull()).select("image", "gt_idx", F.col("cls").alias("read"))
    fate = F.when(F.col("read") == "k00", "correct").when(F.col("read") == "k01", "misread").when(F.col("read").isNull(), "missed").otherwise("other")
    return gt.filter("cls = 'k00'").join(hits, ["image", "gt_idx"], "left").select("image", "gt_idx", fate.alias("fate"))


@query(_RUNS + " SELECT r.run, f.fate, count(x.fate)::BIGINT AS n FROM (VALUES ('control'), ('treatment')) r(run), (VALUES ('correct'), ('misread'), ('missed'), ('other')) f(fate) LEFT JOIN (SELECT 'control' AS run, fate FROM fc UNION ALL SELECT 'treatment', fate FROM fa) x ON x.run = r.run AND x.fate = f.fate GROUP BY ALL")
def target_fates(spark, sf):
    seen = None
    for run, pred, t in (("control", fx.PRED, AT), ("treatment", fx.PRED_A, AT_A)):
        one = _fates(spark, sf, pred, t).select(F.lit(run).alias("run"), "fate")
        seen = one if seen is None else seen.unionByName(one)
    every = spark.createDataFrame([(r, f) for r in ("control", "treatment") for f in ("correct", "misread", "missed", "other")], "run string, fate string")
    return every.join(seen.groupBy("run", "fate").agg(F.count("*").alias("n")), ["run", "fate"], "left").select("run", "fate", F.coalesce("n", F.lit(0)).alias("n"))


_PAIRED = _RUNS + """, d AS (SELECT count(*) FILTER (c.fate = 'misread' AND a.fate <> 'misread')::BIGINT AS b, count(*) FILTER (c.fate <> 'misread' AND a.fate = 'misread')::BIGINT AS c,
  count(*) FILTER (c.fate = 'misread')::BIGINT AS misread_c, count(*) FILTER (a.fate = 'misread')::BIGINT AS misread_t FROM fc c JOIN fa a USING (image, gt_idx)),
  pv AS (SELECT *, CASE WHEN b + c = 0 THEN 1 ELSE least(1, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM range(c + 1) t(k))) END AS p FROM d)"""


@query(_PAIRED + " SELECT b, c, misread_c, misread_t, round(p, 6) AS p FROM pv")
def paired_mcnemar(spark, sf):
    a, t = _fates(spark, sf, fx.PRED, AT), _fates(spark, sf, fx.PRED_A, AT_A)
    return rounded(X.paired(a, t, F.col("fate") == "misread"), "p")


def _scores(spark, sf, pred):
    images, gt, _ = _run(spark, sf)
    ap = M.average_precision(gt, frame(spark, sf, pred).join(images, "image", "left_semi"))
    return ap.select(F.col("cls").alias("name"), F.col("ap").alias("score")).unionByName(M.mean_average_precision(ap).select(F.lit("map").alias("name"), F.col("map").alias("score")))


_GUARD_BODY = _walk("a", "gt", "preda", keys="image, cls") + """,
  ra AS (SELECT cls, count(*) FILTER (took IS NOT NULL) OVER w AS tp, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY cls ORDER BY conf DESC, image, pred_idx ROWS UNBOUNDED PRECEDING)), pa AS (SELECT ra.cls, tp / n_gt AS rec, tp / k AS prec FROM ra JOIN ng USING (cls)),
  apa AS (SELECT ng.cls, avg(coalesce((SELECT max(prec) FROM pa WHERE pa.cls = ng.cls AND rec >= i / 100.0::DOUBLE), 0)) AS ap FROM ng, range(101) g(i) GROUP BY ng.cls),
  gr AS (SELECT cls AS name, ap.ap AS before, apa.ap AS after, ap.ap - apa.ap <= 0.05 + 1e-9 AS ok FROM ap JOIN apa USING (cls) WHERE cls NOT IN ('k00', 'k01')
    UNION ALL SELECT 'map', x, y, y >= x - 0.02 - 1e-9 FROM (SELECT avg(ap) AS x FROM ap), (SELECT avg(ap) AS y FROM apa))"""
_GUARDS = _AP + ", preda AS (" + fx.duck(f"SELECT * FROM ({fx.PRED_A}) p WHERE image IN (SELECT o_orderkey FROM {{orders}} WHERE o_orderkey % 5 = 1)") + "), " + _GUARD_BODY


@query(_GUARDS + " SELECT name, round(before, 6) AS before, round(after, 6) AS after, ok FROM gr")
def guardrails(spark, sf):
    return rounded(R.guardrails(_scores(spark, sf, fx.PRED), _scores(spark, sf, fx.PRED_A), ["k00", "k01"]), "before", "after")


@query(_PAIRED + """, k AS (SELECT (SELECT count(*) FROM fc WHERE fate = 'correct') AS kc, (SELECT count(*) FROM fa WHERE fate = 'correct') AS ka)
  SELECT misread_c, misread_t, kc::BIGINT AS correct_c, ka::BIGINT AS correct_t, CASE WHEN misread_c <= 20 THEN 'void' WHEN misread_t <= misread_c // 2 AND p < 0.05 AND 2 * (ka - kc) >= misread_c - misread_t THEN 'fixed' WHEN misread_t <= misread_c // 2 AND p < 0.05 THEN 'displaced' ELSE 'not fixed' END AS state FROM pv, k""")
def run_decision(spark, sf):
    a, t = _fates(spark, sf, fx.PRED, AT), _fates(spark, sf, fx.PRED_A, AT_A)
    m = X.paired(a, t, F.col("fate") == "misread").withColumn("one", F.lit(1))
    right = lambda df, n: df.agg(F.count_if(F.col("fate") == "correct").alias(n)).withColumn("one", F.lit(1))
    row = m.join(right(a, "correct_c"), "one").join(right(t, "correct_t"), "one")
    c = F.col
    return row.select("misread_c", "misread_t", "correct_c", "correct_t", R.run_decision(c("misread_c"), c("correct_c"), c("misread_t"), c("correct_t"), c("p"), F.lit(True), F.lit(True)).alias("state"))


@query(with_(f=fx.FILES) + """ SELECT image, file, CASE WHEN d <> '' THEN try_strptime(d, '%Y%m%d%H%M%S')::VARCHAR END AS captured_at, (CASE WHEN d <> '' THEN try_strptime(d, '%Y%m%d%H%M%S')::DATE END)::VARCHAR AS day
  FROM (SELECT *, regexp_extract(file, '(IMG|VID|PXL)_([0-9]{8})_([0-9]{6})', 2) || regexp_extract(file, '(IMG|VID|PXL)_([0-9]{8})_([0-9]{6})', 3) AS d FROM f)""")
def manifest_parse(spark, sf):
    at = S.captured_at(F.col("file"))
    return frame(spark, sf, fx.FILES).withColumn("at", at).select("image", "file", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"), F.to_date("at").cast("string").alias("day"))


_CONFLICT = f"""c AS (SELECT a.image, count(*)::BIGINT AS pairs FROM gt a JOIN gt b ON a.image = b.image AND a.gt_idx < b.gt_idx AND a.cls <> b.cls
  WHERE {_INTER.format(a='a', b='b')} / (a.w * a.h + b.w * b.h - {_INTER.format(a='a', b='b')} + 1e-9) > 0.8 GROUP BY a.image)"""


@query(with_(gt=fx.GT) + f", {_CONFLICT} SELECT * FROM c")
def label_conflicts(spark, sf):
    return M.label_conflicts(frame(spark, sf, fx.GT), 0.8)


@query(with_(gt=fx.GT, f=fx.FILES) + f", {_CONFLICT}, n AS (SELECT image, count(*) AS boxes FROM gt GROUP BY image)" + """
  SELECT reason, count(*)::BIGINT AS images FROM (SELECT CASE WHEN file LIKE 'ZE\\_%' ESCAPE '\\' THEN 'third_party_video' WHEN try_strptime(nullif(regexp_extract(file, '_([0-9]{8}_[0-9]{6})', 1), ''), '%Y%m%d_%H%M%S') IS NULL THEN 'third_party_press'
    WHEN coalesce(boxes, 0) = 0 THEN 'no_boxes' WHEN pairs > 0 THEN 'double_labelled' ELSE '' END AS reason FROM f LEFT JOIN n USING (image) LEFT JOIN c USING (image)) GROUP BY reason""")
def exclusion_reason(spark, sf):
    gt = frame(spark, sf, fx.GT)
    rows = frame(spark, sf, fx.FILES).join(gt.groupBy("image").agg(F.count("*").alias("boxes")), "image", "left").join(M.label_conflicts(gt, 0.8), "image", "left")
    reason = S.exclusion(F.col("file"), S.captured_at(F.col("file")), F.coalesce("boxes", F.lit(0)), F.col("pairs") > 0)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("images"))


@query("SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query(with_(gt=fx.GT) + " SELECT image, string_agg(cls || ':' || n, ';' ORDER BY cls) AS boxes, sum(n)::BIGINT AS total FROM (SELECT image, cls, count(*) AS n FROM gt GROUP BY ALL) GROUP BY image")
def box_count_map(spark, sf):
    rows = frame(spark, sf, fx.GT).groupBy("image").agg(F.collect_list("cls").alias("c"))
    rows = rows.select("image", S.format_counts(S.box_counts(F.col("c"))).alias("boxes"))
    return rows.withColumn("total", F.aggregate(F.map_values(S.parse_counts(F.col("boxes"))), F.lit(0).cast("long"), lambda a, n: a + n))


@query(with_(gt=fx.GT, i=fx.IMAGES) + " SELECT cls, split, count(DISTINCT image)::BIGINT AS images, count(*)::BIGINT AS boxes FROM gt JOIN i USING (image) GROUP BY ALL")
def class_coverage(spark, sf):
    rows = frame(spark, sf, fx.GT).groupBy("image", "cls").agg(F.count("*").alias("n")).join(frame(spark, sf, fx.IMAGES), "image")
    return rows.groupBy("cls", "split").agg(F.count("*").alias("images"), F.sum("n").alias("boxes"))


def _signs(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), S.sign_words(F.col("embedding"), 2).alias("words"), F.concat(F.lit("s"), (F.col("label") % 3).cast("string")).alias("split"))


def _members(spark, sf):
    return N.classes(_signs(spark, sf).select("id", "words"))


def _hashes(spark, sf):
    members = _members(spark, sf)
    return members, N.hamming_pairs(members, 64, NEAR_BITS), _signs(spark, sf).select("id", "split")


_BITS = """h AS (SELECT vec_id AS id, 's' || (label % 3) AS split, list_reduce([CASE WHEN v > 0 THEN 1 ELSE 0 END::HUGEINT for v in embedding], lambda a, b: a * 2 + b)::UBIGINT AS bits FROM embeddings),
  near AS (SELECT a.id AS a, b.id AS b, a.split AS sa, b.split AS sb, bit_count(xor(a.bits, b.bits))::BIGINT AS dist FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.bits, b.bits)) <= 16)"""


@query(f"WITH {_BITS}, rep AS (SELECT bits, min(id) AS id FROM h GROUP BY bits) SELECT a, b, dist FROM near WHERE dist > 0 AND a IN (SELECT id FROM rep) AND b IN (SELECT id FROM rep)")
def hamming_pairs(spark, sf):
    return _hashes(spark, sf)[1]


@query(f"WITH {_BITS} SELECT least(sa, sb) AS one, greatest(sa, sb) AS other, count(*)::BIGINT AS pairs FROM near WHERE sa <> sb GROUP BY ALL")
def cross_split_near_dups(spark, sf):
    return N.cross_split_pairs(*_hashes(spark, sf))


@query(f"""WITH {_BITS}, e AS (SELECT a AS id, b AS twin, dist, sa <> sb AS other FROM near UNION ALL SELECT b, a, dist, sa <> sb FROM near), m AS (SELECT id, min(dist) AS d FROM e GROUP BY id),
  t AS (SELECT id, count(*) AS twins, bool_or(other) AS some_, bool_and(other) AS every, arg_min(other, twin) AS first FROM e JOIN m USING (id) WHERE dist = d GROUP BY id)
  SELECT (SELECT count(*) FROM h)::BIGINT AS items, count(*)::BIGINT AS with_twin, count(*) FILTER (twins > 1)::BIGINT AS tied, count(*) FILTER (first)::BIGINT AS nearest_other, count(*) FILTER (every)::BIGINT AS nearest_other_min, count(*) FILTER (some_)::BIGINT AS nearest_other_max,
  (SELECT count(DISTINCT id) FROM e WHERE other)::BIGINT AS any_other FROM t""")
def leakage_counters(spark, sf):
    return N.leakage(*_hashes(spark, sf))


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), "ts", "event_type")


_SESSIONS = "s AS (SELECT event_id AS id, ts, event_type, sum(new) OVER (ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, event_id) <= INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS new FROM events))"


@query(f"WITH {_SESSIONS} SELECT id, session FROM s")
def sessionize(spark, sf):
    return T.sessionize(_events(spark, sf)).select("id", "session")


# Events stand for pictures: 500 apart, two are near if their hashes are.
@query(f"""WITH RECURSIVE {_BITS}, {_SESSIONS}, l AS (SELECT DISTINCT x.session AS a, y.session AS b FROM near JOIN s x ON x.id = near.a JOIN s y ON y.id = near.b WHERE x.session <> y.session),
  bi AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS s, a AS root FROM bi UNION SELECT bi.b, r.root FROM r JOIN bi ON bi.a = r.s), c AS (SELECT s, min(root) AS root FROM r GROUP BY s),
  n AS (SELECT id, ts, coalesce(root, session) AS k FROM s LEFT JOIN c ON c.s = s.session), o AS (SELECT k, row_number() OVER (ORDER BY min(ts), k) AS session FROM n GROUP BY k)
  SELECT id, o.session::BIGINT AS session FROM n JOIN o USING (k)""")
def session_merge(spark, sf):
    links = N.hamming_links(_members(spark, sf), 64, NEAR_BITS)
    return T.merge_sessions(T.sessionize(_events(spark, sf)), links).select("id", "session")


_KINDS = ["click", "purchase", "view"]


def _days(spark, sf):
    block = F.concat(F.lit("d"), (F.floor(F.datediff(F.to_date("ts"), F.lit("2020-01-01")) / 5) % 7).cast("string"))
    return _events(spark, sf).withColumns({"day": block, "classes": F.array("event_type")})


@query("""WITH e AS (SELECT 'd' || ((ts::DATE - DATE '2020-01-01') // 5 % 7) AS day, event_type FROM events), d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) AS n FROM e GROUP BY day),
  k AS (SELECT DISTINCT event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')), m AS (SELECT unnest(range(1, (2 ** (SELECT count(*) FROM d))::BIGINT - 1)) AS mask), t AS (SELECT sum(n) AS n FROM d),
  p AS (SELECT mask, list(day ORDER BY day) AS dates, sum(d.n)::BIGINT AS images FROM m JOIN d ON (mask >> i) & 1 = 1 GROUP BY mask),
  c AS (SELECT mask, k.event_type, count(e.day) FILTER ((mask >> d.i) & 1 = 1) AS test, count(e.day) FILTER ((mask >> d.i) & 1 = 0) AS rest FROM m CROSS JOIN k JOIN e ON e.event_type = k.event_type JOIN d ON d.day = e.day GROUP BY ALL)
  SELECT array_to_string(dates, ',') AS dates, images, round(abs(images / t.n - 0.2), 6) AS gap FROM p, t WHERE images / t.n BETWEEN 0.15 AND 0.25 AND (SELECT min(test) FROM c WHERE c.mask = p.mask) >= 15 AND (SELECT min(rest) FROM c WHERE c.mask = p.mask) >= 100 ORDER BY abs(images / t.n - 0.2), p.dates LIMIT 1""")
def test_date_choice(spark, sf):
    return rounded(T.test_dates(_days(spark, sf), _KINDS), "gap").withColumn("dates", F.array_join("dates", ",")).filter("images is not null")


def _split(spark, sf):
    """Events, test days and validation sessions. Where events are so dense that no set of sessions has the share, there are none of these."""
    days = _days(spark, sf)
    rows = T.sessionize(days)
    dates = T.test_dates(days, _KINDS)
    pool = rows.join(dates.select(F.explode("dates").alias("day")), "day", "left_anti")
    return rows.withColumn("exclusion", F.lit("")), dates, T.val_sessions(pool, _KINDS, rows.count(), needed=False)


@query()
def val_session_choice(spark, sf):
    return _split(spark, sf)[2]


@query()
def split_assignment(spark, sf):
    return T.assign(*_split(spark, sf)).groupBy("split").agg(F.count("*").alias("images"), F.count_distinct("session").alias("sessions"))


@query("""SELECT split, conv_id, turn, (dense_rank() OVER (PARTITION BY split ORDER BY conv_id) - 1)::BIGINT AS image_id, (row_number() OVER (PARTITION BY split ORDER BY conv_id, turn, role, text) - 1)::BIGINT AS annotation_id
  FROM (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM conversations)""")
def materialize_ids(spark, sf):
    from calibra.operators.ranges import numbered

    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("split", F.when(F.col("conv_id") % 5 == 0, "val").otherwise("train"))
    images = numbered(rows.select("split", "conv_id").distinct(), ["split"], [F.col("conv_id")], "image_id").withColumnsRenamed({"split": "_split", "conv_id": "_conv"})
    turns = numbered(rows, ["split"], [F.col(c) for c in ("conv_id", "turn", "role", "text")], "annotation_id")
    same = (F.col("split") == F.col("_split")) & F.col("conv_id").eqNullSafe(F.col("_conv"))
    return turns.join(images, same).select("split", "conv_id", "turn", "image_id", "annotation_id")


def _paired_configs(spark, sf, key, side):
    """How often each field differs in each way between the two sides of each key, over all events."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.struct(key.alias("key"), side.alias("side")).alias("run"), F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit("}")).alias("config"))
    flat = lambda side: R.flatten(rows.filter(F.col("run.side") == side)).withColumn("path", F.concat_ws("#", F.col("run.key").cast("string"), "path"))
    out = R.config_diff(flat(0), flat(1), [], [])
    name = F.substring_index("path", "#", -1)
    return out.groupBy(name.alias("path"), "one", "other", (name == "type").alias("allowed")).agg(F.count("*").alias("n"))


# Of every 400 events, the first 200 are configs and the other 200 those that they are compared with.
@query("""WITH f AS (SELECT event_id // 400 * 200 + event_id % 200 AS k, event_id // 200 % 2 AS side, path, value FROM (SELECT event_id, 'props.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT event_id, 'type', event_type FROM events)),
  p AS (SELECT path, a.value AS one, b.value AS other FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT * FROM f WHERE side = 1) b USING (k, path)) SELECT path, one, other, count(*)::BIGINT AS n, (path = 'type') AS allowed FROM p WHERE one IS DISTINCT FROM other GROUP BY ALL""")
def config_diff(spark, sf):
    return _paired_configs(spark, sf, F.expr("event_id div 400 * 200 + event_id % 200"), F.expr("event_id div 200 % 2"))


# Every event is compared with the next by id.
@query("""WITH f AS (SELECT event_id // 2 AS k, event_id % 2 AS side, path, value FROM (SELECT event_id, 'props.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) UNION ALL SELECT event_id, 'type', event_type FROM events)),
  p AS (SELECT path, a.value AS one, b.value AS other FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT * FROM f WHERE side = 1) b USING (k, path)) SELECT path, one, other, count(*)::BIGINT AS n, (path = 'type') AS allowed FROM p WHERE one IS DISTINCT FROM other GROUP BY ALL""")
def config_diff_all(spark, sf):
    return _paired_configs(spark, sf, F.expr("event_id div 2"), F.expr("event_id % 2"))


_MEASURES = with_(m=fx.MEASURES)
_PAIRS = "coalesce(sum(CASE WHEN p.value > q.value THEN 1 WHEN p.value = q.value THEN 0.5 ELSE 0 END) / nullif(count(*), 0), 'nan'::DOUBLE)"


@query(f"{_MEASURES} SELECT round({_PAIRS}, 6) AS auc, (SELECT count(*) FROM m WHERE grp = 'misread')::BIGINT AS n_pos, (SELECT count(*) FROM m WHERE grp = 'correct')::BIGINT AS n_neg FROM m p JOIN m q ON p.grp = 'misread' AND q.grp = 'correct'")
def auc(spark, sf):
    return rounded(X.auc(frame(spark, sf, fx.MEASURES), "misread", "correct"), "auc")


@query(f"{_MEASURES} SELECT count(DISTINCT p.image)::BIGINT AS clusters, count(*)::BIGINT AS pairs, round({_PAIRS}, 6) AS auc FROM m p JOIN m q ON p.grp = 'misread' AND q.grp = 'correct' AND p.image = q.image")
def within_group_auc(spark, sf):
    return rounded(X.within_groups(frame(spark, sf, fx.MEASURES), "misread", "correct", "image"), "auc")


@query(f"{_MEASURES} SELECT grp, count(value)::BIGINT AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM m GROUP BY grp")
def quantile_summary(spark, sf):
    return rounded(X.describe(frame(spark, sf, fx.MEASURES)), "q1", "median", "q3")


@query(f"{_MEASURES} SELECT grp, count(value)::BIGINT AS boxes, count(DISTINCT image)::BIGINT AS images, count(*) FILTER (value IS NULL)::BIGINT AS unmeasurable FROM m GROUP BY grp")
def group_sizes(spark, sf):
    return X.group_sizes(frame(spark, sf, fx.MEASURES), "image")


@query()
def bootstrap_ci(spark, sf):
    return rounded(X.bootstrap_auc(frame(spark, sf, fx.MEASURES), "misread", "correct", "image", 200, 20260925), "low", "high")


@query(with_(a=fx.ARMS) + f" SELECT arm, count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS successes, {_wilson_sql('count(*) FILTER (success)', 'count(*)')} FROM a GROUP BY arm")
def wilson(spark, sf):
    out = X.arms(frame(spark, sf, fx.ARMS))
    return rounded(out.select("arm", "n", "successes", "low", "high"), "low", "high")


@query(with_(a=fx.ARMS) + " SELECT arm, count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS successes, round(avg(success::INT), 6) AS share, round(median(after_conf - before_conf), 6) AS median_change, round(median(clipped), 6) AS median_clipped FROM a GROUP BY arm")
def arm_summary(spark, sf):
    return rounded(X.arms(frame(spark, sf, fx.ARMS)).drop("low", "high"), "share", "median_change", "median_clipped")


@query(with_(a=fx.ARMS) + """, s AS (SELECT count(*) FILTER (arm = 'arm0') AS n, count(*) FILTER (arm = 'arm0' AND success) AS ring, count(*) FILTER (arm = 'arm1' AND success) AS whole, count(*) FILTER (arm = 'arm2' AND success) % 3 AS sham FROM a)
  SELECT n::BIGINT AS n, CASE WHEN sham > 2 THEN 'pipeline noise' WHEN ring >= n / 2 THEN 'for (local)' WHEN whole >= n / 2 THEN 'for (scene)' WHEN ring <= n / 10 AND whole <= n / 10 THEN 'against' ELSE 'inconclusive' END AS verdict FROM s""")
def recolour_verdict(spark, sf):
    n = lambda arm, c=F.lit(True): F.count_if((F.col("arm") == arm) & c)
    row = frame(spark, sf, fx.ARMS).agg(n("arm0").alias("n"), n("arm0", F.col("success")).alias("ring"), n("arm1", F.col("success")).alias("whole"), (n("arm2", F.col("success")) % 3).alias("sham"))
    return row.select("n", R.gate(F.lit(0), R.recolour(F.col("n"), F.col("ring"), F.col("whole"), F.col("sham"))).alias("verdict"))


@query(with_(**_part()) + f""", t AS (SELECT * FROM gt WHERE cls = 'k00'), x AS (SELECT t.image, t.gt_idx, p.conf, {_INTER.format(a='t', b='p')} AS inter, t.w * t.h + p.w * p.h AS area FROM t JOIN pred p ON p.image = t.image AND p.cls = 'k00')
  SELECT t.image, t.gt_idx, coalesce(max(conf) FILTER (inter / (area - inter) >= 0.5), 0) AS conf FROM t LEFT JOIN x USING (image, gt_idx) GROUP BY t.image, t.gt_idx""")
def best_conf_lookup(spark, sf):
    images, gt, _ = _run(spark, sf)
    return M.best_confidence(gt.filter("cls = 'k00'"), frame(spark, sf, fx.PRED).join(images, "image", "left_semi"), F.lit("k00"))


@query(with_(e=fx.EPOCHS) + " SELECT round(score, 6) AS score, epoch FROM (SELECT epoch, 0 AS col, val AS score FROM e UNION ALL SELECT epoch, 1, ema FROM e) WHERE score IS NOT NULL ORDER BY score DESC, epoch, col LIMIT 1")
def best_epoch(spark, sf):
    return rounded(X.best_epoch(frame(spark, sf, fx.EPOCHS)), "score")


@query(with_(**_part()) + f" SELECT image, string_agg(n || ' x ' || cls, ', ' ORDER BY ord) AS summary FROM (SELECT image, cls, count(*) AS n FROM pred WHERE conf >= {AT} GROUP BY ALL) JOIN {_NAMES_SQL} USING (cls) GROUP BY image")
def detection_summary(spark, sf):
    images = _run(spark, sf)[0]
    return M.summary(frame(spark, sf, fx.PRED).join(images, "image", "left_semi"), AT, _classes(spark))


@query(with_(**_part()) + f""" SELECT image, row_number() OVER (PARTITION BY image ORDER BY conf DESC, pred_idx)::BIGINT AS rank, cls, round_even(conf, 3) AS conf, round_even(x, 0)::BIGINT AS x0, round_even(y, 0)::BIGINT AS y0, round_even(x + w, 0)::BIGINT AS x1, round_even(y + h, 0)::BIGINT AS y1
  FROM pred WHERE conf >= {AT}""")
def visible_sorted(spark, sf):
    images = _run(spark, sf)[0]
    return M.visible(frame(spark, sf, fx.PRED).join(images, "image", "left_semi"), AT)


@query("""SELECT count(*) FILTER (c_acctbal > 0)::BIGINT AS n_yellow, round(median(c_custkey::DOUBLE) FILTER (c_acctbal > 0), 6) AS a_yellow, round(median(c_acctbal) FILTER (c_acctbal > 0), 6) AS b_yellow, count(*) FILTER (c_acctbal <= 0)::BIGINT AS n_blue,
  round(median(c_custkey::DOUBLE) FILTER (c_acctbal <= 0), 6) AS a_blue, round(median(c_acctbal) FILTER (c_acctbal <= 0), 6) AS b_blue, 0::BIGINT AS unmeasurable FROM customer""")
def median_of_medians(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("double").alias("a"), F.col("c_acctbal").alias("b"))
    return rounded(X.median_targets(rows), "a_yellow", "b_yellow", "a_blue", "b_blue")


# The published sRGB and CIELAB constants, written out again.
_COLOURS = "c AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)"
_LINEAR = "CASE WHEN {0} / 255.0::DOUBLE <= 0.04045 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS {0}"
_CURVE = "CASE WHEN {0} > EPS THEN cbrt({0}) ELSE (KAPPA * {0} + 16) / 116 END AS {0}"


def _shade(v: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.when(F.round(v, 6) == 0, 0.0).otherwise(F.round(v, 6))


def _colours(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", *[((F.col("p_partkey") * k) % 256).cast("double").alias(c) for c, k in (("r", 7), ("g", 13), ("b", 29))])


def _lab_sql() -> str:
    from calibra.operators.pixels import EPS, KAPPA, WHITE

    n = lambda v: f"{float(v)!r}::DOUBLE"
    linear, curve = ", ".join(_LINEAR.format(c) for c in "rgb"), ", ".join(_CURVE.format(c) for c in "xyz").replace("EPS", n(EPS)).replace("KAPPA", n(KAPPA))
    xyz = [("0.4124564", "0.3575761", "0.1804375"), ("0.2126729", "0.7151522", "0.0721750"), ("0.0193339", "0.1191920", "0.9503041")]
    t = ", ".join(f"({i}::DOUBLE * r + {j}::DOUBLE * g + {k}::DOUBLE * b) / {n(w)} AS {c}" for c, (i, j, k), w in zip("xyz", xyz, WHITE, strict=True))
    shade = ", ".join(f"CASE WHEN round({e}, 6) = 0 THEN 0.0::DOUBLE ELSE round({e}, 6) END AS {c}" for c, e in (("l", "116 * y - 16"), ("a", "500 * (x - y)"), ("b_star", "200 * (y - z)")))
    return f"WITH {_COLOURS}, l AS (SELECT p_partkey, {linear} FROM c), t AS (SELECT p_partkey, {t} FROM l), f AS (SELECT p_partkey, {curve} FROM t) SELECT p_partkey, {shade} FROM f"


@query(_lab_sql())
def lab_colours(spark, sf):
    from calibra.operators.pixels import lab_columns

    lab = lab_columns(F.col("r"), F.col("g"), F.col("b"))
    return _colours(spark, sf).withColumn("lab", lab).select("p_partkey", *[_shade(F.col(f"lab.{f}")).alias(n) for f, n in (("l", "l"), ("a", "a"), ("b", "b_star"))])


@query(f"WITH {_COLOURS} SELECT p_partkey, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM c")
def lab_inverse(spark, sf):
    from calibra.operators.pixels import lab_columns, rgb_columns

    lab = _colours(spark, sf).withColumn("lab", lab_columns(F.col("r"), F.col("g"), F.col("b")))
    lab = lab.withColumn("rgb", rgb_columns(F.col("lab.l"), F.col("lab.a"), F.col("lab.b")))
    return lab.select("p_partkey", *[_shade(F.col(f"rgb.{c}")).alias(c) for c in "rgb"])


def _picture_boxes(spark, sf):
    """The boxes of one order each, in the pictures' pixels."""
    boxes = frame(spark, sf, fx.GT).withColumns({"w": F.col("w") / 8, "h": F.col("h") / 8})
    rows = boxes.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("gt_idx", "cls", "x", "y", "w", "h"))).alias("b"))
    return rows.select("image", F.transform("b", lambda e: F.struct(e["cls"].alias("cls"), e["x"].alias("x"), e["y"].alias("y"), e["w"].alias("w"), e["h"].alias("h"))).alias("boxes"))


def _pictures(rows):
    """Pictures of 48 x 64 pixels whose colours follow from a part's key, with the other columns of rows(image, ...)."""
    import pyarrow as pa

    def draw(batches):
        import numpy as np

        y, x = np.mgrid[:48, :64].astype(np.uint8)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                k = b.column("image").to_numpy(zero_copy_only=False).astype(np.uint8)[:, None, None]
                # Bytes wrap at 256.
                data = np.stack([x * np.uint8(3) + k, y * np.uint8(5) + k * np.uint8(2), x + y + k * np.uint8(7)], axis=-1)
                ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (3 * 48 * 64))
                pixels = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends.buffers()[1], pa.py_buffer(data)])
                sizes = [pa.array(np.full(b.num_rows, n, np.int32)) for n in (64, 48)]
                names = pa.array([f"p{i}" for i in b.column("image").to_pylist()])
                yield pa.RecordBatch.from_arrays([names, *sizes, pixels, *(b.column(c) for c in others)], ["image", "width", "height", "data", *others])

    others = [c for c in rows.columns if c != "image"]
    return rows.mapInArrow(draw, "image string, width int, height int, data binary" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in others))


@query()
def ring_median(spark, sf):
    from calibra.operators.pixels import measure

    return rounded(measure(_pictures(_picture_boxes(spark, sf))), "ring_a", "ring_b", "plate_chroma")


@query()
def picture_hashes(spark, sf):
    from calibra.operators.phash import perceptual_hash

    return perceptual_hash(_pictures(_picture_boxes(spark, sf).select("image")))


#: Colours that the arms give, and a stand-in for a model: a box at each place of a grid, its class by the colour around it.
COLOURS = {"blue": (5.0, -30.0), "yellow": (0.0, 45.0)}


def grid_model(rgb):
    import numpy as np

    # Sums of whole numbers this small are exact, so products with 0 and 1 are those of the parts.
    rgb = rgb[:34, :52]
    down, across, pixels = _grid(*rgb.shape[:2])
    rows = (down @ rgb.astype(np.float32).reshape(len(rgb), -1)).reshape(3, -1, 3)
    part = ((across @ rows).reshape(15, 3).astype(float) / pixels).tolist()
    return [("k00" if b > r else "k01", g / 255, x, y, 6.0, 9.0) for (x, y), (r, g, b) in zip(PLACES, part, strict=True)]


#: Where the boxes of the stand-in are.
PLACES = [(float(x), float(y)) for y in range(0, 30, 10) for x in range(0, 50, 10)]


@cache
def _grid(height: int, width: int):
    """Which rows each row of the grid sees, which columns each of its columns, and how many pixels each box does."""
    import numpy as np

    seen = [np.array([[at - 4 <= i < at + after for i in range(size)] for at in range(0, end, 10)], np.float32) for size, end, after in ((height, 30, 14), (width, 50, 12))]
    return *seen, np.outer(seen[0].sum(axis=1), seen[1].sum(axis=1)).reshape(-1, 1).astype(float)


def _arm_pictures(spark, sf):
    """Pictures with a box of k00, the place of the first one, and all arms."""
    first = F.array_position(F.transform("boxes", lambda b: b["cls"]), "k00").cast("int") - 1
    return _picture_boxes(spark, sf).withColumns({"target": first, "arms": F.array(*[F.lit(a) for a in ("keep", "reverse", "ring", "sham", "whole")])}).filter("target >= 0")


@query()
def recoloured_arms(spark, sf):
    """What becomes of a target box when each arm alters its picture: how many are read as what, and the median clipped share."""
    from calibra.operators.pixels import read_arms

    place = lambda b: F.struct(*[b[c].alias(c) for c in "xywh"]).alias("box")
    gts = F.transform("boxes", lambda b, i: F.struct(i.cast("long").alias("idx"), place(b)))
    preds = F.sort_array(F.transform("found", lambda d: F.struct((-d["conf"]).alias("rank"), d["pred_idx"].alias("pred_idx"), d["cls"].alias("cls"), d["conf"].alias("conf"), place(d))))
    found = read_arms(_pictures(_arm_pictures(spark, sf)), COLOURS, grid_model).withColumns({"gts": gts, "preds": preds})
    taken = F.arrays_zip(F.col("preds"), M.fold(F.col("preds"), F.col("gts")).alias("taken"))
    read = F.get(F.filter(taken, lambda t: (t["taken"] == F.col("target")) & (t["preds"]["conf"] >= AT)), F.lit(0))["preds"]["cls"]
    out = found.select("arm", "clipped", F.coalesce(read, F.lit(M.MISSED)).alias("outcome")).groupBy("arm", "outcome")
    return rounded(out.agg(F.count("*").alias("n"), F.median("clipped").alias("median_clipped")), "median_clipped")


_GATE = with_(r=fx.RECORDED, l=fx.LOCAL, a=fx.AFTER) + """, g AS (SELECT r.*, l.outcome AS met, r.outcome IS NOT DISTINCT FROM l.outcome AS ok FROM r LEFT JOIN l USING (study, image) WHERE grp IN ('M', 'C')),
  b AS (SELECT study, image, unnest(['ring', 'sham', 'whole']) AS arm FROM g WHERE ok AND grp = 'M' UNION ALL SELECT study, image, 'reverse' FROM g WHERE ok AND grp = 'C' AND ring_b <= 0 UNION ALL SELECT study, image, 'keep' FROM g WHERE ok AND grp = 'C' AND ring_b > 0),
  s AS (SELECT b.*, a.outcome = CASE arm WHEN 'reverse' THEN 'k01' ELSE 'k00' END AS success FROM b JOIN a USING (study, image))"""


def _gate(spark, sf):
    recorded = frame(spark, sf, fx.RECORDED)
    gate = G.baseline(recorded, frame(spark, sf, fx.LOCAL), "study", "image")
    boxes = G.arm_boxes(recorded, gate, "study", "image").join(frame(spark, sf, fx.AFTER), ["study", "image"])
    return gate, boxes.withColumn("success", G.success(F.col("arm"), F.col("outcome"), "k00", "k01"))


@query(_GATE + " SELECT study, image, grp, outcome, met, ok FROM g")
def baseline_gate(spark, sf):
    return _gate(spark, sf)[0].drop("ring_b")


@query(_GATE + " SELECT study, arm, count(*)::BIGINT AS n, count(*) FILTER (success)::BIGINT AS successes FROM s GROUP BY ALL")
def arm_success(spark, sf):
    return _gate(spark, sf)[1].groupBy("study", "arm").agg(F.count("*").alias("n"), F.count_if("success").alias("successes"))


@query(_GATE + """, c AS (SELECT study, count(*) FILTER (NOT ok) AS mismatches FROM g GROUP BY study), v AS (SELECT study, mismatches, count(arm) FILTER (arm = 'ring') AS n, count(*) FILTER (success AND arm = 'ring') AS ring, count(*) FILTER (success AND arm = 'whole') AS whole, count(*) FILTER (success AND arm = 'sham') AS sham FROM c LEFT JOIN s USING (study) GROUP BY ALL)
  SELECT study, mismatches::BIGINT AS mismatches, n::BIGINT AS n, CASE WHEN mismatches > 2 THEN 'no verdict' WHEN sham > 2 THEN 'pipeline noise' WHEN 2 * ring >= n THEN 'for (local)' WHEN 2 * whole >= n THEN 'for (scene)' WHEN 10 * ring <= n AND 10 * whole <= n THEN 'against' ELSE 'inconclusive' END AS verdict FROM v""")
def gated_verdict(spark, sf):
    gate, boxes = _gate(spark, sf)
    n = lambda arm, c=F.lit(True): F.count_if((F.col("arm") == arm) & c)
    arms = boxes.groupBy("study").agg(n("ring").alias("n"), *[n(a, F.col("success")).alias(a) for a in ("ring", "whole", "sham")])
    rows = gate.groupBy("study").agg(F.count_if(~F.col("ok")).alias("mismatches")).join(arms, "study", "left").na.fill(0)
    return rows.select("study", "mismatches", "n", R.gate(F.col("mismatches"), R.recolour(F.col("n"), F.col("ring"), F.col("whole"), F.col("sham"))).alias("verdict"))


_CASES = with_(c=fx.CASES)


@query(_CASES + """ SELECT k, CASE WHEN least(boxes_m, boxes_c) < 15 OR least(images_m, images_c) < 6 THEN 'inconclusive' WHEN auc >= 0.7 AND low > 0.55 THEN 'for' WHEN auc <= 0.3 AND high < 0.45 THEN 'reversed' WHEN low >= 0.3 AND high <= 0.7 THEN 'against' ELSE 'inconclusive' END AS verdict FROM c""")
def backdrop_verdict(spark, sf):
    names = ("boxes_m", "boxes_c", "images_m", "images_c", "auc", "low", "high")
    return frame(spark, sf, fx.CASES).select("k", R.backdrop(*[F.col(n) for n in names]).alias("verdict"))


@query(_CASES + """ SELECT k, CASE WHEN NOT valid THEN 'invalid' WHEN m_c <= 20 THEN 'void' WHEN m_a > m_c // 2 OR p >= 0.05 THEN 'not fixed' WHEN 2 * (k_a - k_c) < m_c - m_a THEN 'displaced' WHEN safe THEN 'fixed' ELSE 'fixed at a cost' END AS verdict FROM c""")
def run_decision_cases(spark, sf):
    names = ("m_c", "k_c", "m_a", "k_a", "p", "safe", "valid")
    return frame(spark, sf, fx.CASES).select("k", R.run_decision(*[F.col(n) for n in names]).alias("verdict"))


_FIELDS = ["commit_", "library", "versions", "split_sizes", "gpu", "threshold"]


@query(with_(r=fx.RECORDS) + ", p AS (SELECT pair, a.* EXCLUDE (pair), b AS other_ FROM (SELECT * FROM r WHERE side = 0) a FULL JOIN (SELECT r AS b, pair FROM r WHERE side = 1) USING (pair)) " + " UNION ALL ".join(f"SELECT pair, '{f}' AS field, {f} AS one, other_.{f} AS other FROM p WHERE {f} IS DISTINCT FROM other_.{f}" for f in _FIELDS))
def record_differences(spark, sf):
    rows = frame(spark, sf, fx.RECORDS)
    return G.record_differences(rows.filter("side = 0"), rows.filter("side = 1"), ["pair"], _FIELDS)


@query(with_(r=fx.RECORDS) + " SELECT id, 'run' AS problem FROM r WHERE run IS NULL OR run <> expected UNION ALL SELECT id, 'config_check' FROM r WHERE check_ok IS NULL OR NOT check_ok")
def record_problems(spark, sf):
    return G.record_problems(frame(spark, sf, fx.RECORDS), "id")


@query("WITH c AS (SELECT DISTINCT p_partkey % 3 AS split, p_size AS id, p_brand AS name FROM part) SELECT id, name, count(*)::BIGINT AS splits FROM c GROUP BY ALL HAVING count(*) < (SELECT count(DISTINCT split) FROM c)")
def category_differences(spark, sf):
    return G.category_differences(spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") % 3).alias("split"), F.col("p_size").alias("id"), F.col("p_brand").alias("name")))


@query("WITH d AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, o_orderkey % 5 = 1 AS test FROM orders) SELECT day FROM d GROUP BY day HAVING bool_or(test) AND NOT bool_and(test)")
def shared_days(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("image"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    return G.shared_days(rows.join(frame(spark, sf, fx.IMAGES), "image"))


@query(with_(gt=fx.GT) + " SELECT 'several' AS reason, count(*)::BIGINT AS n FROM (SELECT image FROM gt WHERE cls = 'k00' GROUP BY image HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'number', count(*) FROM gt WHERE cls = 'k00' HAVING count(*) <> 100")
def target_refusals(spark, sf):
    return G.target_refusals(frame(spark, sf, fx.GT), "k00", 100)


@query(with_(p=fx.PATHS) + " SELECT id, regexp_full_match(path, 'train_config[.](aug_config|augmentation_backend|seed|dataset_dir|output_dir)([.].*)?') AS allowed, regexp_extract(file, '[^/\\\\]*$') AS file, "
  "list_transform(range(8), lambda i: ('0x' || sha256(name)[8 * i + 1 : 8 * i + 8])::BIGINT)::VARCHAR AS words FROM p")
def names_and_bits(spark, sf):
    words = F.concat(F.lit("["), F.array_join(F.transform(S.hex_words(F.sha2("name", 256)), lambda w: w.cast("string")), ", "), F.lit("]"))
    return frame(spark, sf, fx.PATHS).select("id", G.allowed_field(F.col("path")).alias("allowed"), S.basename(F.col("file")).alias("file"), words.alias("words"))


@query(with_(gt=fx.GT) + """, c AS (SELECT image, gt_idx, round_even(x, 0)::BIGINT AS x0, round_even(y, 0)::BIGINT AS y0, round_even(x + w, 0)::BIGINT AS x1, round_even(y + h, 0)::BIGINT AS y1,
  greatest(0, ceil(x - 0.5))::BIGINT AS first, ceil(x + w - 0.5)::BIGINT AS stop FROM gt) SELECT image, gt_idx, x0, y0, x1 - x0 AS wide, y1 - y0 AS high, first, greatest(first, least(48, stop)) AS stop FROM c""")
def box_pixels(spark, sf):
    box = P.sizes(P.corners(P.box()))
    span = P.span(F.col("x"), F.col("x") + F.col("w"), F.lit(48))
    rows = frame(spark, sf, fx.GT).select("image", "gt_idx", box.alias("s"), span.alias("p"))
    return rows.select("image", "gt_idx", F.col("s.x").alias("x0"), F.col("s.y").alias("y0"), F.col("s.w").alias("wide"), F.col("s.h").alias("high"), F.col("p.first").alias("first"), F.col("p.end").alias("stop"))


@query("""SELECT side, grp, count(*)::BIGINT AS n FROM (SELECT CASE WHEN o_totalprice > 150000 THEN 'yellow' ELSE 'blue' END AS side,
  CASE WHEN o_custkey % 5 = 4 THEN 'missed' WHEN o_custkey % 5 = (o_orderkey + 1) % 4 THEN 'misread' WHEN o_custkey % 5 = o_orderkey % 4 THEN 'correct' ELSE 'other' END AS grp FROM orders) GROUP BY ALL""")
def outcome_groups(spark, sf):
    name = lambda v: F.concat(F.lit("k"), v.cast("string"))
    key, pred = F.col("o_orderkey"), F.col("o_custkey") % 5
    group = S.outcome_group(name(key % 4), F.when(pred == 4, "missed").otherwise(name(pred)), name((key + 1) % 4))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(S.side(F.col("o_totalprice") - 150000).alias("side"), group.alias("grp"))
    return rows.groupBy("side", "grp").agg(F.count("*").alias("n"))


# Each event's configuration against the next one's: text from the event's type, a file in a folder of its own, a note that does not count.
_CONFIGS = """c AS (SELECT event_id // 2 AS k, event_id % 2 AS side, event_type AS lr, event_id % 3 AS seed, '/c' || (event_id % 5) || '/' || event_type || '.pt' AS file FROM events),
  p AS (SELECT coalesce(a.k, b.k) AS k, a.lr AS lr, b.lr AS lr2, a.file AS file, b.file AS file2, a.lr || '.pt' AS name, b.lr || '.pt' AS name2, b.seed AS seed, b.k AS there FROM (SELECT * FROM c WHERE side = 0) a FULL JOIN (SELECT * FROM c WHERE side = 1) b USING (k))"""


def _flat_configs(spark, sf):
    body = """'{"train_config": {"lr": "' || event_type || '", "seed": ' || event_id % 3 || ', "epochs": 50.0}, "model_config": {"pretrain_weights": "/c' || event_id % 5 || '/' || event_type || '.pt", "sizes": [1, 2]}, "note": {"id": ' || event_id || '}}'"""
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id div 2 AS k", "event_id % 2 AS side", f"{body} AS config")
    # Each side is flattened on its own: a filter on what has been flattened would open every configuration twice.
    return tuple(R.flatten(rows.filter(F.col("side") == side), "k") for side in (0, 1))


@query(f"""WITH {_CONFIGS} SELECT path, one, other, count(*)::BIGINT AS n FROM (SELECT 'train_config.lr' AS path, lr AS one, lr2 AS other FROM p WHERE lr IS DISTINCT FROM lr2 UNION ALL SELECT 'model_config.pretrain_weights', file, file2 FROM p WHERE name IS DISTINCT FROM name2
  UNION ALL SELECT f.path, f.v, NULL FROM p, (VALUES ('train_config.epochs', '50'), ('model_config.sizes', '[1,2]')) f(path, v) WHERE there IS NULL UNION ALL SELECT f.path, NULL, f.v FROM p, (VALUES ('train_config.epochs', '50'), ('model_config.sizes', '[1,2]')) f(path, v) WHERE lr IS NULL) GROUP BY ALL""")
def config_rule(spark, sf):
    return G.config_problems(*_flat_configs(spark, sf), ["k"]).groupBy("path", "one", "other").agg(F.count("*").alias("n"))


@query(f"WITH {_CONFIGS} SELECT 'train_config.seed' AS path, '1' AS wanted, seed::VARCHAR AS value, count(*)::BIGINT AS n FROM p WHERE there IS NOT NULL AND seed <> 1 GROUP BY ALL")
def treatment_rule(spark, sf):
    flat = _flat_configs(spark, sf)[1]
    wanted = flat.select("k").distinct().select("k", F.lit("train_config.seed").alias("path"), F.lit("1").alias("value"))
    return G.treatment_problems(flat, wanted, ["k"]).groupBy("path", "wanted", "value").agg(F.count("*").alias("n"))


@query(with_(r=fx.RECORDED, l=fx.LOCAL) + " SELECT l.study, count(*)::BIGINT AS n FROM l LEFT JOIN r USING (study, image) WHERE r.ring_b IS NULL GROUP BY l.study")
def uncovered_targets(spark, sf):
    rings = frame(spark, sf, fx.RECORDED).withColumnRenamed("ring_b", "value")
    return G.uncovered(frame(spark, sf, fx.LOCAL), rings, "study", "image").groupBy("study").agg(F.count("*").alias("n"))


@query(with_(r=fx.RECORDED, l=fx.LOCAL) + """, x AS (SELECT study, CASE WHEN outcome IN ('k00', 'k01') THEN outcome ELSE 'other' END AS outcome, 1 AS a, 0 AS b FROM r UNION ALL SELECT study, CASE WHEN outcome IN ('k00', 'k01') THEN outcome ELSE 'other' END, 0, 1 FROM l)
  SELECT study, outcome, sum(a)::BIGINT AS recorded, sum(b)::BIGINT AS scored FROM x GROUP BY ALL HAVING sum(a) <> sum(b)""")
def not_reproduced(spark, sf):
    return G.not_reproduced(frame(spark, sf, fx.RECORDED), frame(spark, sf, fx.LOCAL), ["k00", "k01"], "study")


@query(_PAIRED + ", " + _AP_BODY + ", " + _GUARD_BODY + f""", rec AS ({fx.duck(fx.RECORDS)}), k AS (SELECT (SELECT count(*) FROM fc WHERE fate = 'correct') AS kc, (SELECT count(*) FROM fa WHERE fate = 'correct') AS ka, (SELECT bool_and(ok) FROM gr) AS safe),
  bad AS (SELECT pair, (count(*) FILTER (run IS NULL OR run <> expected) + count(*) FILTER (coalesce(NOT check_ok, true)))::BIGINT AS problems FROM rec GROUP BY pair)
  SELECT pair, problems, CASE WHEN problems > 0 THEN 'invalid' WHEN misread_c <= 20 THEN 'void' WHEN misread_t <= misread_c // 2 AND p < 0.05 AND 2 * (ka - kc) >= misread_c - misread_t THEN CASE WHEN safe THEN 'fixed' ELSE 'fixed at a cost' END WHEN misread_t <= misread_c // 2 AND p < 0.05 THEN 'displaced' ELSE 'not fixed' END AS state FROM bad, pv, k""")
def run_result(spark, sf):
    """The decision with everything that it hangs on: paired boxes, all guardrails, and for each pair of records their own checks."""
    a, t = _fates(spark, sf, fx.PRED, AT), _fates(spark, sf, fx.PRED_A, AT_A)
    right = lambda df, n: df.agg(F.count_if(F.col("fate") == "correct").alias(n))
    safe = R.guardrails(_scores(spark, sf, fx.PRED), _scores(spark, sf, fx.PRED_A), ["k00", "k01"]).agg(F.bool_and("ok").alias("safe"))
    numbers = X.paired(a, t, F.col("fate") == "misread").withColumn("one", F.lit(1))
    for one_row in (right(a, "correct_c"), right(t, "correct_t"), safe):
        numbers = numbers.join(one_row.withColumn("one", F.lit(1)), "one")
    records = frame(spark, sf, fx.RECORDS)
    problems = G.record_problems(records, "pair").groupBy("pair").agg(F.count("*").alias("problems"))
    pairs = records.select("pair").distinct().join(problems, "pair", "left").na.fill(0, ["problems"]).withColumn("one", F.lit(1))
    c = F.col
    decided = R.run_decision(c("misread_c"), c("correct_c"), c("misread_t"), c("correct_t"), c("p"), c("safe"), c("problems") == 0)
    return pairs.join(F.broadcast(numbers), "one").select("pair", "problems", decided.alias("state"))  # one row
