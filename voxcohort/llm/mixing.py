"""Mixing sources to target weights by iterative proportional fitting; DataFrame operations only.

Documents fall into cells (source, lang, topic). Cell weights start at 1 and are raked, margin after margin, until the
weighted tokens of every source, language and topic are in proportion to its target. Documents are then sampled with
probability min(1, scale * cell weight), where `scale` is calibrated so that the expected tokens meet the budget.

A target share is a margin's observed share to the power of its temperature, normalised: 1 keeps the corpus's mix, 0
makes all values equal. Explicit shares may be given for any margin; values they do not name get none.
Only cells and margins are iterated on: the texts are read once to count, and once to draw. Up to ROW_STEPS steps of cell
times margin value a round, all cells are arrays of one row, and raking and calibration are one expression over them;
beyond that they are windows over a table of cells. Both compute the same.

Topic: the `topic` column where the table has one, else the form of the text (see `topic_of`).
Tokens: runs of characters other than [\\x20\\x09-\\x0D].
Defined cases: null source, lang or topic is a value of its own ('' in the result's cell columns stays null); a null or
empty text has 0 tokens and gets its cell's probability; repeated rows have one draw by doc_id and text, so they are
kept or left together; an empty table gives an empty table; other columns pass through, those named like the results
are replaced.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_name, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Temperatures of the target shares.
TEMPERATURE = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS, ROUNDS_A_TABLE, CALIBRATIONS = 12, 4, 6
ROW_STEPS = 2_000_000
OUT = ("n_tokens", "cell_weight", "probability", "selected")


def topic_of(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("http")) | F.contains(text, F.lit("@")), "linked")
        .when(F.contains(text, F.lit("\n")), "prose")
        .otherwise("line")
    )


def tokens_of(text: Column) -> Column:
    spaced = text
    for blank in "\t\n\u000b\f\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    # Few texts have runs of blanks; only those go through the slower collapse.
    single = F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))
    return F.when(single == "", 0).otherwise(F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "))) + 1).cast("bigint")


def draw_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from doc_id, text and seed."""
    name = F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.encode(text, "utf-8")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def targets(cells: DataFrame, margin: str, temperature: float, shares: dict[str, float] | None) -> DataFrame:
    """(margin, share) with shares that sum to 1."""
    per = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where(F.col("t") > 0)
    if shares is not None:
        wanted = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map().cast("map<string,double>")
        raw = per.withColumn("share", F.coalesce(F.try_element_at(wanted, F.col(margin)).cast("double"), F.lit(0.0)))
    else:
        raw = per.withColumn("share", F.pow(F.col("t").cast("double"), F.lit(float(temperature))))
    whole = raw.agg(F.sum("share").alias("whole"))
    return raw.crossJoin(F.broadcast(whole)).select(margin, F.try_divide("share", "whole").alias("share"))  # one row


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """`cells` (margins, tokens) with `weight`, raked to the goals."""
    now = cells.withColumn("weight", F.lit(1.0))
    for name, goal in goals.items():
        same = now[name].eqNullSafe(goal[name])
        now = now.join(goal, same, "left").drop(goal[name]).withColumnRenamed("share", f"goal_{name}")
    for i in range(rounds):
        for name in goals:
            every = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy("one"))
            own = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(name))
            now = now.withColumn("one", F.lit(1)).withColumn("every", every).withColumn("own", own)
            now = now.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"goal_{name}") * F.col("every"), F.col("own")), F.lit(0.0))).drop("one", "every", "own")
        if i % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1:
            now = durable(now, "raked-cells")
    return now


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """`cells` with `probability` = min(1, scale * weight); cells that reach 1 leave the rest of the budget to others."""
    whole = Window.partitionBy(F.lit(1))
    now = cells.withColumn("probability", F.lit(0.0))
    for _ in range(CALIBRATIONS):
        full = F.col("probability") >= 1
        left = F.lit(budget) - F.coalesce(F.sum(F.when(full, F.col("tokens"))).over(whole), F.lit(0))
        free = F.sum(F.when(~full, F.col("tokens") * F.col("weight"))).over(whole)
        now = now.withColumn("scale", F.try_divide(left.cast("double"), free))
        now = now.withColumn("probability", F.when(full, 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("scale") * F.col("weight"))), F.lit(0.0)))).drop("scale")
    return now


def in_one_row(cells: DataFrame, goals: dict[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    """`cells` with weight and probability as `rake` and `calibrate` give them, from one row that holds all cells."""
    now = cells
    for name, goal in goals.items():
        # A number for each value of the margin, and its goal.
        numbered = goal.join(F.broadcast(cells.select(F.col(name).alias("value")).distinct()), F.col(name).eqNullSafe(F.col("value")), "right")
        numbered = numbered.select(F.col("value"), F.col("share").alias(f"goal_{name}"), (F.row_number().over(Window.orderBy("value")) - 1).alias(f"at_{name}"))
        now = now.join(F.broadcast(numbered), F.col(name).eqNullSafe(F.col("value"))).drop("value")
    row = now.groupBy().agg(F.sort_array(F.collect_list(F.struct(*cells.columns, *[f"{x}_{m}" for m in goals for x in ("goal", "at")]))).alias("c"))
    tokens = lambda k: F.get("c", k)["tokens"].cast("double")
    every = F.sequence(F.lit(0), F.size("c") - 1)
    total = lambda part: F.aggregate(every, F.lit(0.0), lambda a, k: a + F.coalesce(part(k), F.lit(0.0)))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  `value` is computed once

    def raked(name: str, weights: Column) -> Column:
        at, goal = (partial(lambda x, k: F.get("c", k)[f"{x}_{name}"], x) for x in ("at", "goal"))
        mass = lambda k: tokens(k) * F.get(weights, k)
        last = F.array_max(F.transform("c", lambda c: c[f"at_{name}"]))
        own = F.transform(F.sequence(F.lit(0), last), lambda v: total(lambda k: F.when(at(k) == v, mass(k))))
        new = lambda s: F.transform(every, lambda k: F.coalesce(F.get(weights, k) * F.try_divide(goal(k) * s["whole"], F.get(s["own"], at(k))), F.lit(0.0)))
        return let(F.struct(total(mass).alias("whole"), own.alias("own")), new)

    def one_round(weights: Column) -> Column:
        for name in goals:
            weights = let(weights, partial(raked, name))
        return weights

    def calibrated(chances: Column) -> Column:
        full = lambda k: F.get(chances, k) >= 1
        left = F.lit(float(budget)) - total(lambda k: F.when(full(k), tokens(k)))
        free = total(lambda k: F.when(~full(k), tokens(k) * F.get("w", k)))
        chance = lambda scale, k: F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scale * F.get("w", k))), F.lit(0.0))
        return let(F.try_divide(left, free), lambda scale: F.transform(every, lambda k: F.when(full(k), F.lit(1.0)).otherwise(chance(scale, k))))

    steps = lambda n: F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
    constant = lambda value: F.transform(every, lambda k: F.lit(value))
    row = row.where(F.size("c") > 0).withColumn("w", F.aggregate(steps(rounds), constant(1.0), lambda w, i: one_round(w)))
    row = row.withColumn("p", F.aggregate(steps(CALIBRATIONS), constant(0.0), lambda p, i: calibrated(p)))
    out = row.select(F.explode(F.arrays_zip("c", F.col("w").alias("w"), F.col("p").alias("p"))).alias("x"))
    return out.select(*[F.col("x.c")[m].alias(m) for m in cells.columns], F.col("x.w").alias("weight"), F.col("x.p").alias("probability"))


def weighted(cells: DataFrame, goals: dict[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    """`cells` with weight and probability, in one row or by windows, as their number allows."""
    n, *values = cells.agg(F.count("*"), *[F.count_distinct(F.coalesce(F.concat(F.lit("v"), m), F.lit(""))) for m in goals]).first()
    if n * sum(values) <= ROW_STEPS:
        return in_one_row(cells, goals, budget, rounds)
    return calibrate(rake(cells, goals, rounds), budget)


def mix(docs: DataFrame, fraction: float = 0.5, seed: int = 17, temperature: dict[str, float] | None = None, shares: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Every row of `docs` with topic, n_tokens, cell_weight, probability and selected; the expected tokens of the
    selected rows are `fraction` of all tokens, as near as probabilities up to 1 allow."""
    text = text_or_empty()
    own_topic = "topic" in docs.columns
    kept = [c for c in docs.columns if c not in OUT]
    draw, *names = (free_name(docs, x) for x in ("own_draw", *[f"cell_{m}" for m in MARGINS]))
    rows = docs.select(*kept, *([] if own_topic else [topic_of(text).alias("topic")]), tokens_of(text).alias("n_tokens"), draw_of(F.col("doc_id"), text, seed).alias(draw))
    counted = rows.select(*[F.col(m).cast("string").alias(m) for m in MARGINS], "n_tokens")
    cells = durable(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
    heat = TEMPERATURE | (temperature or {})
    goals = {m: targets(cells, m, heat[m], (shares or {}).get(m)) for m in MARGINS}
    budget = (cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    weights = weighted(cells, goals, budget, rounds).select(*[F.col(m).alias(c) for m, c in zip(MARGINS, names, strict=True)], F.col("weight").alias("cell_weight"), "probability")
    weights = durable(weights, "mixing-weights")
    on = [F.col(m).cast("string").eqNullSafe(F.col(c)) for m, c in zip(MARGINS, names, strict=True)]
    bounded = weights.count() <= 100_000  # a few MB; beyond that Spark plans the join itself
    joined = rows.join(F.broadcast(weights) if bounded else weights, on[0] & on[1] & on[2], "left")
    return joined.select(*kept, *([] if own_topic else ["topic"]), "n_tokens", "cell_weight", "probability", (F.col(draw) < F.col("probability")).alias("selected"))
