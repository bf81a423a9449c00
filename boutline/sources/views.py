"""The two central tables, two-sided bouts and market quotes, derived from the test schema.

``bouts`` has a row per order whose first two lines have different suppliers; the supplier of the first
line is the red side, that of the second the blue one. ``quotes`` has a row per event with two decimal odds.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What each side has per bout; ``r_`` and ``b_`` go before these names.
STATS = (
    "ss_landed", "ss_att", "td_landed", "td_att", "kd", "sub_att", "ctrl_sec", "body_landed", "leg_landed",
    "clinch_landed", "ground_landed", "r1_ss_landed", "r1_ss_att", "r1_ctrl_sec", "late_ss_landed", "late_ss_att", "late_ctrl_sec",
)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies, wherever they are started."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a side's line that its statistics are made of.
LINE = {"id": "l_suppkey", "landed": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "part": "l_partkey", "flag": "l_returnflag"}


def _side_stats(side: str) -> dict[str, Column]:
    c = lambda k: F.col(f"{side}_{k}")
    landed = c("landed")
    attempts = landed + c("thousands")
    control = F.round(c("discount") * 1000)
    return {
        "ss_landed": landed,
        "ss_att": attempts,
        "td_landed": F.round(c("discount") * 100),
        "td_att": F.round((c("discount") + c("tax")) * 100),
        "kd": (c("tax") >= 0.06).cast("double"),
        "sub_att": (c("part") % 3).cast("double"),
        "ctrl_sec": control,
        "body_landed": F.floor(landed * 0.2).cast("double"),
        "leg_landed": F.floor(landed * (c("part") % 5) * 0.05).cast("double"),
        "clinch_landed": F.floor(landed * (c("id") % 4) * 0.05).cast("double"),
        "ground_landed": F.floor(landed * (c("part") % 7) * 0.03).cast("double"),
        "r1_ss_landed": F.floor(landed * 0.4).cast("double"),
        "r1_ss_att": F.floor(attempts * 0.4).cast("double"),
        "r1_ctrl_sec": F.floor(control * 0.5).cast("double"),
        "late_ss_landed": F.floor(landed * 0.3).cast("double"),
        "late_ss_att": F.floor(attempts * 0.35).cast("double"),
        "late_ctrl_sec": F.floor(control * 0.25).cast("double"),
    }


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout with the columns of either line that ``with_stats`` needs, which are a third as many as what it makes of them.

    One shuffle by order number ranks the lines and folds both sides into a row.
    """
    first = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").withColumn("_rank", F.row_number().over(first)).where("_rank <= 2")
    sides = [F.max(F.when(F.col("_rank") == n, F.col(c))).alias(f"{side}_{k}") for n, side in ((1, "r"), (2, "b")) for k, c in LINE.items()]
    pairs = lines.groupBy("l_orderkey").agg(*sides).where("r_id <> b_id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey")
    rows = pairs.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    method = F.when(F.col("r_flag") == "R", "KO/TKO").when(F.col("r_flag") == "A", "SUB").otherwise("DEC")
    winner = F.when(F.col("r_landed") == F.col("b_landed"), "draw").when(F.col("r_price") > F.col("b_price"), "r").otherwise("b")
    kept = [k for k in LINE if k not in ("price", "flag")]
    return rows.select(
        F.col("o_orderkey").alias("bout_id"), F.to_date("o_orderdate").alias("dt"), winner.alias("winner"), method.alias("method"), F.col("o_orderpriority").alias("weight_class"), F.col("o_custkey").alias("cust"),
        *[f"{side}_{k}" for side in "rb" for k in kept], *[F.floor(F.col(f"{side}_price") / 1000).alias(f"{side}_thousands") for side in "rb"],
    )


def with_stats(rows: DataFrame, *more: str) -> DataFrame:
    """The bouts of ``pairings``: clocks and the statistics of both sides, and of ``rows`` also the columns ``more``."""
    sched = F.when(F.col("weight_class").startswith("1"), 1500).otherwise(900).cast("long")
    total = F.when(F.col("method") == "DEC", sched).otherwise(F.ceil(F.col("r_landed") * sched / 51).cast("long"))
    out = rows.select(
        "bout_id", *[c.alias(f"{side}_{k}") for side in "rb" for k, c in _side_stats(side).items()],
        "dt", F.to_date(F.date_trunc("month", "dt")).alias("event"), "r_id", "b_id", "winner", "method", "weight_class", "cust", sched.alias("sched_sec"), total.alias("total_sec"), *more,
    )
    return out.withColumn("deep_rounds", F.greatest(F.ceil(F.col("total_sec") / 300).cast("long") - 2, F.lit(0).cast("long")))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bout. The lines are shuffled as they are: the statistics, of which there are more than columns of a line, are made of those that are left."""
    return with_stats(pairings(spark, sf_dir))


def appearances(rows: DataFrame, met: tuple[str, ...] = ()) -> DataFrame:
    """One row per side of a bout: its own and its opponent's statistics, and the result for it.

    Of each of ``met``, which ``rows`` has by ``r_`` and ``b_``, a side gets its opponent's by ``o_``.
    """

    def side(own: str, other: str, wins: str) -> Column:
        result = F.when(F.col("winner") == wins, "W").when(F.col("winner") == other, "L").otherwise("D")
        return F.struct(
            F.lit(own).alias("side"), F.col(f"{own}_id").alias("entity"), F.col(f"{other}_id").alias("opponent"), result.alias("result"),
            *[F.col(f"{own}_{k}").alias(k) for k in STATS], *[F.col(f"{other}_{k}").alias(f"opp_{k}") for k in STATS],
            *[F.col(f"{other}_{k}").alias(f"o_{k}") for k in met],
        )

    common = ["bout_id", "dt", "event", "method", "weight_class", "sched_sec", "total_sec", "deep_rounds"]
    return rows.select(*common, F.inline(F.array(side("r", "b", "r"), side("b", "r", "b"))))


def cornered(rows: DataFrame, met: tuple[str, ...] = ()) -> DataFrame:
    """What ``appearances`` gives, of rows that are there once for each ``side`` already and have each of ``met`` by ``o_``."""
    red = F.col("side") == "r"
    of = lambda own, other: F.when(red, F.col(own)).otherwise(F.col(other))
    result = F.when(F.col("winner") == F.col("side"), "W").when(F.col("winner").isin("r", "b"), "L").otherwise("D")
    return rows.select(
        "bout_id", "dt", "event", "method", "weight_class", "sched_sec", "total_sec", "deep_rounds", "side", "entity", of("b_id", "r_id").alias("opponent"), result.alias("result"),
        *[of(f"r_{k}", f"b_{k}").alias(k) for k in STATS], *[of(f"b_{k}", f"r_{k}").alias(f"opp_{k}") for k in STATS], *[f"o_{k}" for k in met],
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with two decimal odds above one, and the probability of the first side without the margin."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("quote_id"), F.col("user_id").alias("pair"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("snap"),
        (1 + F.col("value") / 100).alias("o1"), (1 + k / 50).alias("o2"),
    )
    rows = rows.where("o1 > 1 and o2 > 1")
    return rows.withColumn("p1", (1 / F.col("o1")) / (1 / F.col("o1") + 1 / F.col("o2")))


# --- the same views in DuckDB SQL, for the oracles ---

_SQL_STATS = {
    "price": "l_extendedprice", "id": "l_suppkey", "flag": "l_returnflag",
    "ss_landed": "l_quantity", "ss_att": "(l_quantity + floor(l_extendedprice / 1000))", "td_landed": "round(l_discount * 100)",
    "td_att": "round((l_discount + l_tax) * 100)", "kd": "CASE WHEN l_tax >= 0.06::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sub_att": "(l_partkey % 3)::DOUBLE", "ctrl_sec": "round(l_discount * 1000)",
    "body_landed": "floor(l_quantity * 0.2::DOUBLE)", "leg_landed": "floor(l_quantity * (l_partkey % 5) * 0.05::DOUBLE)",
    "clinch_landed": "floor(l_quantity * (l_suppkey % 4) * 0.05::DOUBLE)", "ground_landed": "floor(l_quantity * (l_partkey % 7) * 0.03::DOUBLE)",
    "r1_ss_landed": "floor(l_quantity * 0.4::DOUBLE)", "r1_ss_att": "floor((l_quantity + floor(l_extendedprice / 1000)) * 0.4::DOUBLE)",
    "r1_ctrl_sec": "floor(round(l_discount * 1000) * 0.5::DOUBLE)", "late_ss_landed": "floor(l_quantity * 0.3::DOUBLE)",
    "late_ss_att": "floor((l_quantity + floor(l_extendedprice / 1000)) * 0.35::DOUBLE)", "late_ctrl_sec": "floor(round(l_discount * 1000) * 0.25::DOUBLE)",
}


def _sql_bouts() -> str:
    ranked = ", ".join(f"{v} AS _{k}" for k, v in _SQL_STATS.items())
    sides = ", ".join(f"max(CASE WHEN rk = {n} THEN _{k} END) AS {s}_{k}" for n, s in ((1, "r"), (2, "b")) for k in _SQL_STATS)
    kept = ", ".join(f"{s}_{k}" for s in "rb" for k in STATS)
    return f"""ranked AS (
        SELECT l_orderkey, {ranked}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rk FROM lineitem
    ), sides AS (SELECT l_orderkey, {sides} FROM ranked WHERE rk <= 2 GROUP BY l_orderkey), based AS (
        SELECT o_orderkey AS bout_id, CAST(o_orderdate AS DATE) AS dt, CAST(date_trunc('month', o_orderdate) AS DATE) AS event, r_id, b_id,
               CASE WHEN r_ss_landed = b_ss_landed THEN 'draw' WHEN r_price > b_price THEN 'r' ELSE 'b' END AS winner,
               CASE r_flag WHEN 'R' THEN 'KO/TKO' WHEN 'A' THEN 'SUB' ELSE 'DEC' END AS method, o_orderpriority AS weight_class, o_custkey AS cust,
               CASE WHEN o_orderpriority LIKE '1%' THEN 1500 ELSE 900 END AS sched_sec, {kept}
        FROM sides JOIN orders ON l_orderkey = o_orderkey WHERE r_id <> b_id
    ), timed AS (
        SELECT *, CASE WHEN method = 'DEC' THEN sched_sec ELSE CAST(ceil(r_ss_landed * sched_sec / 51) AS BIGINT) END AS total_sec FROM based
    ), bouts AS (SELECT *, greatest(CAST(ceil(total_sec / 300.0::DOUBLE) AS BIGINT) - 2, 0) AS deep_rounds FROM timed)"""


def _sql_app() -> str:
    def side(own: str, other: str) -> str:
        stats = ", ".join([f"{own}_{k} AS {k}" for k in STATS] + [f"{other}_{k} AS opp_{k}" for k in STATS])
        return f"""SELECT bout_id, dt, event, method, weight_class, sched_sec, total_sec, deep_rounds, '{own}' AS side, {own}_id AS entity, {other}_id AS opponent,
            CASE winner WHEN '{own}' THEN 'W' WHEN '{other}' THEN 'L' ELSE 'D' END AS result, {stats} FROM bouts"""

    return f"app AS ({side('r', 'b')} UNION ALL {side('b', 'r')})"


SQL = {
    "bouts": _sql_bouts(),
    "app": _sql_app(),
    "quotes": """quotes AS (SELECT *, (1 / o1) / (1 / o1 + 1 / o2) AS p1 FROM (
        SELECT event_id AS quote_id, user_id AS pair, event_type AS source, ts AS snap, 1 + value / 100 AS o1,
               1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 AS o2 FROM events) WHERE o1 > 1 AND o2 > 1)""",
}


def with_views(*names: str) -> str:
    """``WITH`` and the views of these names, in the order they need."""
    return "WITH " + ", ".join(SQL[n] for n in names)
