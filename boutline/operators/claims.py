"""What a bout's joint distribution says in each market, and whether it came true: one row per bout and market.

The joint is the probability of each side, way and round, from hazards by the minute. Every market is a sum of its cells,
so all claims of a bout agree with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.operators.grading import round_by_ceiling

WAYS = {"a_ko": 1, "b_ko": 2, "a_sub": 3, "b_sub": 4}
ROUNDS = range(1, 6)


def joint(hazards: DataFrame) -> DataFrame:
    """Per bout: ``{way}_r{round}``, the decision, and ``curve``, the survival after each minute."""
    stay = 1 - sum((F.col(f"h{k}") for k in range(1, 5)), F.lit(0.0))
    w = Window.partitionBy("bout_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    rows = hazards.select("*", F.coalesce(F.product(stay).over(w), F.lit(1.0)).alias("alive"), stay.alias("stay"))
    rows = rows.withColumn("round", F.floor((F.col("minute") - 1) / 5) + 1)
    cells = [F.sum(F.when(F.col("round") == r, F.col("alive") * F.col(f"h{k}")).otherwise(0.0)).alias(f"{way}_r{r}") for way, k in WAYS.items() for r in ROUNDS]
    curve = F.transform(F.array_sort(F.collect_list(F.struct("minute", (F.col("alive") * F.col("stay")).alias("s")))), lambda x: x["s"])  # a bout's minutes
    out = rows.groupBy("bout_id").agg(*cells, F.min(F.col("alive") * F.col("stay")).alias("decision"), F.max("sched_sec").alias("sched_sec"), curve.alias("curve"))
    return out.withColumn("n_rounds", (F.col("sched_sec") / 300).cast("int"))


def way(name: str, rounds: range = ROUNDS) -> Column:
    """The probability of a side and way over some rounds."""
    return sum((F.col(f"{name}_r{r}") for r in rounds), F.lit(0.0))


def ends_in(r: int) -> Column:
    return sum((F.col(f"{k}_r{r}") for k in WAYS), F.lit(0.0))


def survival_at(minutes: float) -> Column:
    """The survival at a time between minutes, linear between the two; one before the first, that of the last after it."""
    whole, part = int(minutes), minutes - int(minutes)
    at = lambda i: F.coalesce(F.get("curve", F.lit(i)), F.element_at("curve", -1))
    if whole == 0:
        return F.lit(1.0)
    return at(whole - 1) if part == 0 else at(whole - 1) + (at(whole) - at(whole - 1)) * F.lit(part)


def expected_minutes() -> Column:
    """Finishes at the middle of their round, decisions at the full distance."""
    return sum((ends_in(r) * F.lit((r - 1) * 5 + 2.5) for r in ROUNDS), F.lit(0.0)) + F.col("decision") * F.col("n_rounds") * 5


def winner_a() -> Column:
    return way("a_ko") + way("a_sub") + F.col("decision") / 2


def markets() -> dict[str, Column]:
    """The probability of each market; null where the bout has no such round or the rows no such column."""
    finish = {s: way(f"{s}_ko") + way(f"{s}_sub") for s in "ab"}
    win = {"a": winner_a(), "b": 1 - winner_a()}
    has = lambda r, c: F.when(F.col("n_rounds") >= r, c)
    before = lambda r: sum((ends_in(k) for k in range(1, r)), F.lit(0.0))
    out = {"winner_a": win["a"], "inside_distance": 1 - F.col("decision"), "decision": F.col("decision")}
    out |= {"method_ko": way("a_ko") + way("b_ko"), "method_sub": way("a_sub") + way("b_sub"), "method_dec": F.col("decision")}
    for s in "ab":
        out |= {f"ko_{s}": way(f"{s}_ko"), f"sub_{s}": way(f"{s}_sub"), f"finish_{s}": finish[s], f"dec_{s}": F.greatest(F.lit(0.0), win[s] - finish[s])}
        out |= {f"takedown_{s}": F.col(f"p_takedown_{s}"), f"knockdown_{s}": F.col(f"p_knockdown_{s}")}
    out |= {f"end_r{r}": has(r, ends_in(r)) for r in ROUNDS}
    out |= {f"ends_before_r{r}": has(r, before(r)) for r in ROUNDS if r > 1}
    out |= {f"starts_r{r}": has(r, 1 - before(r)) for r in ROUNDS if r > 1}
    out |= {f"total_over_{k}_5": has(k + 1, survival_at(5 * k + 2.5)) for k in range(1, 5)}
    out |= {f"rov_{name}_r{r}": has(r, F.col(f"{name}_r{r}")) for name in WAYS for r in ROUNDS}
    return out


def claims(joints: DataFrame) -> DataFrame:
    """``(bout_id, market, p)`` of every market that has a probability."""
    pairs = F.array(*[F.struct(F.lit(k).alias("market"), c.alias("p")) for k, c in markets().items()])
    return joints.select("bout_id", F.inline(F.filter(pairs, lambda x: x["p"].isNotNull())))


def happened() -> dict[str, Column]:
    """Whether each market came true, the first side being the red one; those of a side are null for a draw or no contest."""
    rnd, dec = round_by_ceiling(F.col("total_sec")), F.col("method") == "DEC"
    a = F.when(F.col("winner").isin("r", "b"), F.col("winner") == "r")
    won, by = {"a": a, "b": ~a}, {"ko": F.col("method") == "KO/TKO", "sub": F.col("method") == "SUB"}
    red = {"a": "r", "b": "b"}
    out = {"winner_a": a, "inside_distance": ~dec, "decision": dec, "method_ko": by["ko"], "method_sub": by["sub"], "method_dec": dec}
    for s in "ab":
        out |= {f"{m}_{s}": won[s] & by[m] for m in by} | {f"finish_{s}": won[s] & ~dec, f"dec_{s}": won[s] & dec}
        out |= {f"takedown_{s}": F.col(f"{red[s]}_td_landed") > 0, f"knockdown_{s}": F.col(f"{red[s]}_kd") > 0}
    out |= {f"end_r{r}": ~dec & (rnd == r) for r in ROUNDS}
    out |= {f"ends_before_r{r}": ~dec & (rnd < r) for r in ROUNDS if r > 1}
    out |= {f"starts_r{r}": dec | (rnd >= r) for r in ROUNDS if r > 1}
    out |= {f"total_over_{k}_5": F.col("total_sec") > 300 * k + 150 for k in range(1, 5)}
    return out | {f"rov_{s}_{m}_r{r}": won[s] & by[m] & (rnd == r) for s in "ab" for m in by for r in ROUNDS}


def outcomes(bouts: DataFrame) -> DataFrame:
    """``(bout_id, market, hit)`` of every market."""
    pairs = F.array(*[F.struct(F.lit(k).alias("market"), c.cast("int").alias("hit")) for k, c in happened().items()])
    return bouts.select("bout_id", F.inline(pairs))


def settled(joints: DataFrame, bouts: DataFrame) -> DataFrame:
    """``(bout_id, market, p, hit)`` of every market with a probability and an outcome. Both meet by the bout, before there is a row for each market."""
    facts = bouts.select("bout_id", "total_sec", "method", "winner", "r_td_landed", "b_td_landed", "r_kd", "b_kd")
    hit = happened()
    told = F.array(*[F.struct(F.lit(k).alias("market"), c.alias("p"), hit[k].cast("int").alias("hit")) for k, c in markets().items()])
    return joints.join(facts, "bout_id").select("bout_id", F.inline(F.filter(told, lambda x: x["p"].isNotNull() & x["hit"].isNotNull())))


def market_scores(told: DataFrame, hits: DataFrame) -> DataFrame:
    """Per market of settled claims: base rate, Brier score, that of the base rate, and the skill."""
    rows = told.join(hits.where("hit is not null"), ["bout_id", "market"])
    y = F.col("hit").cast("double")
    out = rows.groupBy("market").agg(F.count("*").alias("n"), F.avg(y).alias("base"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"))
    base = F.col("base") * (1 - F.col("base"))
    return out.select("market", "n", "base", "brier", base.alias("brier_base"), (base - F.col("brier")).alias("skill"))


def likeliest() -> Column:
    """The name of the largest of a bout's five ways to end; ties go to the later name."""
    named = [F.struct(c.alias("p"), F.lit(k).alias("name")) for k, c in {**{k: way(k) for k in WAYS}, "decision": F.col("decision")}.items()]
    return F.array_max(F.array(*named))["name"]
