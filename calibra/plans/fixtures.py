"""Tables of boxes, predictions, files and hashes derived from the star schema, as SQL that Spark and DuckDB share.

Where the two dialects differ, a name in braces stands for the difference; the tables' own names are in braces too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"day": "date_format({}, 'yyyyMMdd')", "clock": "date_format({}, 'HHmmss')"}
DUCK = {"day": "strftime({}, '%Y%m%d')", "clock": "strftime({}, '%H%M%S')"}
CLASSES = 11
#: Names of the classes, in report order.
NAMES = [f"k{i:02d}" for i in range(CLASSES)]
#: Classes that are taken for each other: 0 and 1, 2 and 3, and so on; the last has no partner.
PARTNERS = {a: b for i in range(0, CLASSES - 1, 2) for a, b in ((NAMES[i], NAMES[i + 1]), (NAMES[i + 1], NAMES[i]))}

_NAME = "'k' || lpad(CAST(({}) % 11 AS STRING), 2, '0')"
_LINES = """SELECT l_orderkey AS image, l_partkey AS part, l_suppkey AS supp, CAST(l_linenumber AS BIGINT) AS line, l_quantity AS qty, l_extendedprice AS price,
    131 * l_partkey + 17 * l_suppkey + 29 * CAST(l_linenumber AS BIGINT) AS lk,
    CAST(10 * (l_partkey % 5) AS DOUBLE) AS x, CAST(10 * (l_suppkey % 4) AS DOUBLE) AS y, 20 + l_quantity AS w, CAST(40 + l_partkey % 60 AS DOUBLE) AS h FROM {lineitem}"""
GT = f"""SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY line, part, supp, qty, price) - 1 AS BIGINT) AS gt_idx, {_NAME.format('part')} AS cls, x, y, w, h FROM ({_LINES}) lines"""


def predictions(confuse: int, drop: int) -> str:
    """Predictions of one run: every `confuse`-th true box gets the next class, every `drop`-th none."""
    conf = "CAST(({}) % 100 AS DOUBLE) / 100"
    return f"""SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY kind, line, part, supp, qty, price) - 1 AS BIGINT) AS pred_idx, cls, conf, x, y, w, h FROM (
      SELECT image, 0 AS kind, line, part, supp, qty, price, CASE WHEN lk % {confuse} = 0 THEN {_NAME.format('part + 1')} ELSE {_NAME.format('part')} END AS cls, {conf.format('lk')} AS conf, x + (lk % 9 - 4) AS x, y + (lk % 5 - 2) AS y, w, h FROM ({_LINES}) a WHERE lk % {drop} <> 0
      UNION ALL SELECT image, 1, line, part, supp, qty, price, {_NAME.format('part')}, {conf.format('lk + 37')}, x + 1000, y, w, h FROM ({_LINES}) b WHERE lk % 17 = 0
      UNION ALL SELECT image, 2, line, part, supp, qty, price, {_NAME.format('part')}, {conf.format('lk + 53')}, x + 1, y + 1, w, h FROM ({_LINES}) c WHERE lk % 11 = 0) kinds"""


PRED, PRED_A = predictions(7, 13), predictions(19, 23)
IMAGES = "SELECT o_orderkey AS image, CASE WHEN o_orderkey % 5 = 0 THEN 'val' WHEN o_orderkey % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM {orders}"
FILES = """SELECT o_orderkey AS image, CASE WHEN o_orderkey % 6 = 0 THEN 'ZE_' || CAST(o_orderkey AS STRING) || '.png' WHEN o_orderkey % 6 = 1 THEN CAST(o_orderkey AS STRING) || '.webp'
    WHEN o_orderkey % 6 = 2 THEN 'PXL_' || {day:o_orderdate} || '_' || {clock:o_orderdate} || '_BURST' || CAST(o_orderkey AS STRING) || '_COVER.jpg'
    WHEN o_orderkey % 6 = 3 THEN 'IMG_20251399_999999.jpg' ELSE 'IMG_' || {day:o_orderdate} || '_' || {clock:o_orderdate} || '.jpg' END AS file FROM {orders}"""
#: Box measures: a group, a value and a cluster.
MEASURES = "SELECT c_custkey AS box, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'misread' ELSE 'correct' END AS grp, c_acctbal AS value, CAST(c_nationkey AS BIGINT) AS image FROM {customer}"
#: Arm outcomes: arm, image, confidence before and after, success and clipped share.
ARMS = """SELECT 'arm' || CAST(s_suppkey % 5 AS STRING) AS arm, s_suppkey AS image, CAST(s_suppkey % 97 AS DOUBLE) / 100 AS before_conf, CAST((s_suppkey * 7) % 97 AS DOUBLE) / 100 AS after_conf,
    (s_suppkey * 7) % 97 > 40 AS success, CAST(s_suppkey % 10 AS DOUBLE) / 10 AS clipped FROM {supplier}"""
#: Validation scores by epoch; one in seven is missing.
EPOCHS = """SELECT CAST(s_suppkey AS BIGINT) AS epoch, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST((s_suppkey * 37) % 41 AS DOUBLE) / 41 END AS val, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST((s_suppkey * 53) % 41 AS DOUBLE) / 41 END AS ema FROM {supplier}"""
#: Boxes of studies: a group, the outcome on record, and the colour of the ring, which one in nine lacks.
RECORDED = """SELECT c_nationkey AS study, c_custkey AS image, CASE WHEN c_custkey % 4 = 0 THEN 'M' WHEN c_custkey % 4 = 3 THEN 'missed' ELSE 'C' END AS grp,
    CASE WHEN c_custkey % 4 = 0 THEN 'k01' WHEN c_custkey % 4 = 3 THEN 'missed' ELSE 'k00' END AS outcome, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal - 4500 END AS ring_b FROM {customer}"""
#: The outcomes met again, which one in 97 lacks, and those after a change of colours.
LOCAL = "SELECT c_nationkey AS study, c_custkey AS image, CASE WHEN c_custkey % 31 = 0 THEN 'missed' WHEN c_custkey % 4 = 0 THEN 'k01' ELSE 'k00' END AS outcome FROM {customer} WHERE c_custkey % 97 <> 0"
AFTER = "SELECT c_nationkey AS study, c_custkey AS image, CASE WHEN (c_custkey * 7 + c_nationkey) % 5 < 2 THEN 'k01' WHEN c_custkey % 6 = 0 THEN 'missed' ELSE 'k00' END AS outcome FROM {customer}"
#: Numbers that the written rules decide on, a case for each supplier.
CASES = """SELECT s_suppkey AS k, s_suppkey % 40 AS boxes_m, (s_suppkey * 3) % 50 AS boxes_c, s_suppkey % 13 AS images_m, (s_suppkey * 5) % 17 AS images_c, CAST(s_suppkey % 11 AS DOUBLE) / 10 AS auc,
    CAST(s_suppkey % 11 AS DOUBLE) / 10 - CAST(s_suppkey % 7 AS DOUBLE) / 20 AS low, CAST(s_suppkey % 11 AS DOUBLE) / 10 + CAST(s_suppkey % 5 AS DOUBLE) / 20 AS high,
    15 + s_suppkey % 60 AS m_c, s_suppkey % 20 AS k_c, s_suppkey % 23 AS m_a, 5 + (s_suppkey * 11) % 60 AS k_a, CAST(s_suppkey % 8 AS DOUBLE) / 100 AS p, s_suppkey % 3 <> 0 AS safe, s_suppkey % 10 <> 0 AS valid FROM {supplier}"""
#: Records of two runs, the even customer's and the odd one's.
RECORDS = """SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS pair, c_custkey % 2 AS side, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_mktsegment END AS commit_, CAST(c_nationkey % 3 AS STRING) AS library,
    CAST(c_custkey % 7 AS STRING) AS versions, CAST(length(c_name) AS STRING) AS split_sizes, CASE WHEN c_acctbal > 0 THEN 'a' ELSE 'b' END AS gpu, CAST(c_nationkey AS STRING) AS threshold,
    CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN '2C' ELSE '2A' END AS run, '2A' AS expected, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 9 <> 0 END AS check_ok, c_custkey AS id FROM {customer}"""
PATHS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'train_config.' WHEN p_partkey % 3 = 1 THEN 'model_config.' ELSE '' END || CASE WHEN p_size % 4 = 0 THEN 'seed' WHEN p_size % 4 = 1 THEN 'aug_config.flip' WHEN p_size % 4 = 2 THEN 'lr' ELSE 'output_dir' END AS path,
    CASE WHEN p_partkey % 2 = 0 THEN 'C:' || chr(92) || 'cache' || chr(92) ELSE '/cache/' END || p_name AS file, p_name AS name FROM {part}"""

_HOLE = re.compile(r"\{(\w+)(?::(\w+))?\}")


def duck(sql: str) -> str:
    return _HOLE.sub(lambda m: DUCK[m[1]].format(m[2]) if m[2] else m[1], sql).replace("AS STRING)", "AS VARCHAR)")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The fixture over the Parquet tables of sf_dir."""
    names = {m[1] for m in _HOLE.finditer(sql) if not m[2]}
    text = _HOLE.sub(lambda m: SPARK[m[1]].format(m[2]) if m[2] else m[0], sql)
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def with_(**ctes: str) -> str:
    """The head of a DuckDB query over fixtures."""
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({duck(sql)})" for name, sql in ctes.items())
