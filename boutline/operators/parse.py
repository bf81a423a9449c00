"""Card files to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def card_lines(lines: DataFrame) -> DataFrame:
    """Lines ``(n, line)`` of a card to bouts: ``# event | date | venue``, ``## segment``, ``A vs. B [| rounds] [| division]``.

    The segment is carried forward to the bouts below it; those above any are on the main card.
    """
    line = F.trim("line")
    segment = F.when(line.startswith("## "), F.trim(F.substring(line, F.lit(4), F.length(line))))
    header = F.when(line.startswith("# "), F.substring(line, F.lit(3), F.length(line)))
    w = Window.partitionBy("card").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("card", "n", line.alias("line"), F.last(segment, True).over(w).alias("segment"), F.last(header, True).over(w).alias("header"))
    fields = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    names = F.split(F.get(fields, 0), r"\s+vs\.?\s+", 2)
    rounds = F.get(F.filter(fields, lambda x: x.rlike(r"^\d$")), F.lit(0)).try_cast("int")
    division = F.get(F.filter(F.slice(fields, 2, 9), lambda x: ~x.rlike(r"^\d$")), F.lit(0))
    bouts = rows.where(F.col("line").rlike(r"\svs\.?\s") & ~F.col("line").startswith("#"))
    head = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    return bouts.select(
        "card", "n", F.get(head, 0).alias("event"), F.get(head, 1).alias("date"), F.coalesce("segment", F.lit("Main card")).alias("segment"), F.get(names, 0).alias("a"), F.get(names, 1).alias("b"),
        F.coalesce(rounds, F.lit(3)).alias("rounds"), division.alias("division"),
    )


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """The bouts of all card files under ``path``; a file is a card, known by the last folder of its place."""
    card = F.regexp_extract(F.input_file_name(), r"([^/=]+)/[^/]*$", 1)
    lines = spark.read.text(path, wholetext=True).select(card.alias("card"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return card_lines(lines)
