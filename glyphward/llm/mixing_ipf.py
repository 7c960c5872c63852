"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents are counted in cells of source, language and topic. Every value of a dimension has a target
of tokens: its share of those that are to stay, but no more than it has; what it lacks the others
make up for by their shares. Raking starts all cells at one rate and multiplies the rates in turn by
what each marginal lacks, where no cell gives more than all it has. So the rates are the calibrated
probabilities by which documents are drawn, and the drawn tokens have the target marginals as far as
cells allow. The draw is a hash of the id, the same in every run and everywhere.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphward.llm.tables import drop, save

ROUNDS = 12  # between two looks at the marginals
LOOKS = 5  # at most
GAP = 1e-3  # share of the tokens that stay by which marginals may miss their targets; raking ends there
SMALL = 200_000  # cells that are raked in a single stage; more are raked by joins with the marginals
FLATTEN = 0.75  # targets are proportional to tokens to this power, unless they are given
DIMENSIONS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Tokens of a text as the mix weighs them: a quarter of its characters, rounded up; at least one."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic from what the text holds: code or tables, digits, questions, or prose by its length."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")) | F.contains(text, F.lit("{")), "structured")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")), "contact")
        .when(F.contains(text, F.lit("?")), "question")
        .when(F.char_length(text) < 800, "short prose")
        .when(F.char_length(text) < 4000, "prose")
        .otherwise("long prose")
    )


def cell(docs: DataFrame, kind: Column | None = None) -> Column:
    """struct(source, lang, topic, tokens) of a document; ``kind`` is the topic, :func:`topic` of the text by default. Null source and language are values of their own."""
    named = zip(DIMENSIONS, (F.col("source"), F.col("lang"), topic(F.col("text")) if kind is None else kind), strict=True)
    return F.struct(*(F.coalesce(c.cast("string"), F.lit("")).alias(d) for d, c in named), tokens(F.col("text")).alias("tokens"))


def marginal_targets(cells: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float) -> DataFrame:
    """(dimension, value, tokens, target): the tokens of each marginal and how many of them are to stay, ``keep`` of all in each dimension.

    ``targets`` gives the shares of a dimension's values (values it leaves out get none); dimensions
    that it leaves out get shares in proportion to tokens to the power FLATTEN. A value gets
    min(tokens, c * share); c is found on the driver from sums over values, a dimension in a row.
    """
    pair = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("pair")
    held = cells.select(pair, "tokens").groupBy("pair.dimension", "pair.value").agg(F.sum("tokens").alias("tokens"))
    share = F.pow(F.col("tokens").cast("double"), FLATTEN)
    for d, shares in (targets or {}).items():
        given = F.create_map(*(F.lit(x) for p in shares.items() for x in p)) if shares else F.lit(None).cast("map<string,double>")
        share = F.when(F.col("dimension") == d, F.coalesce(given[F.col("value")].cast("double"), F.lit(0.0))).otherwise(share)
    marginals = save(held.withColumn("share", share), "marginals")
    scale: dict[str, float] = dict.fromkeys(DIMENSIONS, 0.0)
    while True:
        full = _of_dimension(scale) * F.col("share") >= F.col("tokens")
        sums = marginals.groupBy("dimension").agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("given"), F.sum(F.when(~full, F.col("share")).otherwise(0.0)).alias("sharing"))
        new = {r["dimension"]: (keep * r["all"] - r["given"]) / r["sharing"] if r["sharing"] > 0 else scale[r["dimension"]] for r in sums.collect()}
        if all(new.get(d, s) <= s * (1 + 1e-12) for d, s in scale.items()):
            break
        scale = {d: max(s, new.get(d, s)) for d, s in scale.items()}
    wanted = F.least(F.col("tokens").cast("double"), _of_dimension(scale) * F.col("share"))
    out = save(marginals.select("dimension", "value", "tokens", wanted.alias("target")), "targets")
    drop(marginals)
    return out


def _of_dimension(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))[F.col("dimension")]


def _of(marginals: DataFrame, d: str, column: str) -> DataFrame:
    """(value of dimension ``d``, ``column`` under the dimension's name)."""
    return marginals.where(F.col("dimension") == d).select(F.col("value").alias(d), F.col(column).alias(f"{d}_{column}"))


def _given(rate: Column) -> Column:
    return F.col("tokens") * F.least(F.lit(1.0), rate)


def _rake_small(now: DataFrame, marginals: DataFrame, rounds: int) -> DataFrame:
    """``rounds`` rounds over (source, lang, topic, tokens, rate) in a single stage over one partition."""
    for d in DIMENSIONS:
        now = now.join(_of(marginals, d, "target"), d)
    now = now.repartition(1)
    for _ in range(rounds):
        for d in DIMENSIONS:
            held = F.sum(_given(F.col("rate"))).over(Window.partitionBy(d))
            now = now.withColumn("rate", F.when(held > 0, F.col("rate") * F.col(f"{d}_target") / held).otherwise(F.lit(0.0)))
    return now.select(*DIMENSIONS, "tokens", "rate")


def _rake_large(cells: DataFrame, marginals: DataFrame, rounds: int) -> DataFrame:
    """The same with a factor for each value of each dimension; a round is an aggregation of the cells for each dimension."""
    factors = {d: _of(marginals.withColumn("factor", F.lit(1.0)), d, "factor") for d in DIMENSIONS}
    kept: dict[str, DataFrame] = {}

    def rated() -> DataFrame:
        now, rate = cells, F.col("rate")
        for d in DIMENSIONS:
            now = now.join(factors[d], d)  # broadcast only where Spark finds the written table small enough
            rate = rate * F.col(f"{d}_factor")
        return now.select(*DIMENSIONS, "tokens", rate.alias("rate"))

    for _ in range(rounds):
        for d in DIMENSIONS:
            held = rated().groupBy(d).agg(F.sum(_given(F.col("rate"))).alias("held"))
            lack = F.when(F.col("held") > 0, F.col(f"{d}_target") / F.col("held")).otherwise(F.lit(0.0))
            now = save(held.join(_of(marginals, d, "target"), d).join(factors[d], d).select(d, (F.col(f"{d}_factor") * lack).alias(f"{d}_factor")), "factors")
            if d in kept:
                drop(kept[d])
            factors[d] = kept[d] = now
    return rated()


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.5, rounds: int = ROUNDS, looks: int = LOOKS, small: int = SMALL) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability): the share of each cell in the tokens that stay, and the rate at which it gives its own.

    ``cells`` has a row for each cell with its tokens. After every ``rounds`` rounds the marginals are
    looked at; raking ends when they miss their targets by GAP at most, or with a warning after
    ``looks`` looks, as where single cells have too little. At most ``small`` cells are raked in one
    stage; more stay dealt over all tasks and only marginals are gathered.
    """
    cells = save(cells, "sums")
    marginals = marginal_targets(cells, targets, keep)
    step = _rake_small if cells.count() <= small else _rake_large
    now, gap, before = cells.withColumn("rate", F.lit(float(keep))), 0.0, None
    for _ in range(looks):
        now = save(step(now, marginals, rounds), "raked")
        if before is not None:
            drop(before)
        before = now
        out = now.withColumn("probability", F.least(F.lit(1.0), F.col("rate"))).drop("rate")
        gap = marginal_gap(out, marginals)
        if gap <= GAP:
            break
    else:
        warnings.warn(f"marginals miss their targets by {gap:.2%} of the mix", stacklevel=2)
    total = out.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or 0.0
    weight = F.col("tokens") * F.col("probability") / F.lit(total) if total else F.lit(0.0)
    drop(cells, marginals)
    out = out.withColumn("weight", weight)
    out.kept_at = now.kept_at  # what :func:`drop` deletes once the result has been read
    return out


def marginal_gap(raked: DataFrame, marginals: DataFrame) -> float:
    """The largest difference between the expected tokens of a dimension's values and their targets, as a share of all targets of the dimension."""
    pair = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS))).alias("pair")
    got = raked.select(pair, (F.col("tokens") * F.col("probability")).alias("got")).groupBy("pair.dimension", "pair.value").agg(F.sum("got").alias("got"))
    rows = got.join(marginals, ["dimension", "value"]).groupBy("dimension").agg((F.sum(F.abs(F.col("got") - F.col("target"))) / F.nullif(F.sum("target"), F.lit(0.0))).alias("gap"))
    return rows.agg(F.max("gap")).first()[0] or 0.0


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 48 bits of a digest of the seed, the id and, for rows without one, the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.5, rounds: int = ROUNDS, seed: int = 42, column: str = "mix", kind: Column | None = None) -> DataFrame:
    """``docs`` with struct column ``column``: source, lang, topic, tokens, weight, probability and drawn.

    weight and probability: those of :func:`rake` for the document's cell. ``kind`` is a column for the
    topic, as of a classifier; columns of ``docs`` that happen to be named topic do not count.
    Repeated rows share their draw. Null texts count as empty, one token. Other columns stay, whatever
    their names; one named ``column`` is replaced. No rows give no rows.
    """
    marked = docs.withColumn(column, cell(docs, kind))
    own = F.col(column)
    sums = marked.groupBy(*(own[d].alias(d) for d in DIMENSIONS)).agg(F.sum(own["tokens"]).alias("tokens"))
    raked = rake(sums, targets, keep, rounds)
    cells = save(raked, "cells")
    drop(raked)
    rates = cells.select(F.struct(*DIMENSIONS).alias(f"{column} at"), F.struct("weight", "probability").alias(f"{column} rate"))
    joined = marked.join(rates, F.struct(*(own[d].alias(d) for d in DIMENSIONS)) == F.col(f"{column} at"))
    rate = F.col(f"{column} rate")
    drawn = draw(F.col("doc_id"), F.col("text"), seed) < rate["probability"]
    whole = F.struct(*(own[c].alias(c) for c in (*DIMENSIONS, "tokens")), *(rate[c].alias(c) for c in ("weight", "probability")), drawn.alias("drawn"))
    return joined.withColumn(column, whole).drop(f"{column} at", f"{column} rate")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.5, rounds: int = ROUNDS, seed: int = 42, kind: Column | None = None) -> DataFrame:
    """The documents drawn by :func:`calibrated`, with the columns of ``docs``."""
    column = "mix"
    while column in docs.columns:
        column += " "
    return calibrated(docs, targets, keep, rounds, seed, column, kind).where(F.col(column)["drawn"]).select(*docs.columns)
