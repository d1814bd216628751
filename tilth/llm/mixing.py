"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic). Raking scales the cells in turn until the weighted sums
match the targets of each of the three; a cell's factor is then the product of three. Factors are scaled to a fixed
overall rate, so that no cell, however scarce, sets the rate of the others. A document of factor f is drawn floor(f)
times, and once more with probability f - floor(f), decided by the hash of its id: scarce documents are repeated, and
the drawn tokens match all targets in expectation.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import cut

#: Up to so many cells are raked on the driver and their factors broadcast; more stay tables. The factors are alike.
LOCAL_CELLS = 500_000
#: Without given targets, a value's share is its token share to this power, made to sum to 1.
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 0.95}


def form_topic(text: Column, n_tokens: Column) -> Column:
    """A topic for tables without one: the text's form."""
    bars = F.regexp_count(text, F.lit(r"\|"))
    return F.when(bars * 5 > n_tokens, "table").when(n_tokens < 50, "note").when(n_tokens < 1000, "article").otherwise("long")


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Factors of cells so that factor * weight sums to ``targets`` over each dimension's ``codes``. Targets of values
    without weight are spread over the others in proportion. Targets that no factors meet together (a value with a goal
    whose every cell another target sets to 0) leave the last round's factors, with a warning."""
    factor = np.ones(len(weights))
    if not weights.sum():
        return factor
    goals = []
    for c, t in zip(codes, targets, strict=True):
        t = np.where(np.bincount(c, weights, len(t)) > 0, t, 0.0)
        goals.append(t / t.sum() if t.sum() else np.bincount(c, weights, len(t)) / weights.sum())
    for _ in range(rounds):
        off = 0.0
        for c, goal in zip(codes, goals, strict=True):
            now = np.bincount(c, factor * weights, len(goal))
            ratio = np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)
            off = max(off, np.abs(ratio[goal > 0] - 1).max(initial=0) if now.sum() > 0 else 0)
            factor *= ratio[c]
        if off < tol:
            break
    else:
        warnings.warn(f"raking is still off by {off:.2g} after {rounds} rounds", stacklevel=2)
    return factor


def rake_tables(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 500, tol: float = 1e-7) -> DataFrame:
    """rake() by grouped sums and joins, for any number of cells: ``cells`` with a column ``factor``. ``goals`` has
    (value, goal) of each dimension, for just the values with weight."""
    dims = list(goals)
    parts = {d: cut(goals[d].select(d, "goal", F.lit(1.0).alias(f"_{d}"), F.lit(1.0).alias("ratio"))) for d in dims}

    def times(skipped: str | None = None) -> DataFrame:
        out, product = cells, F.lit(1.0)
        for d in dims:
            if d != skipped:
                out, product = out.join(parts[d].select(d, f"_{d}"), d, "left"), product * F.col(f"_{d}")
        return out.withColumn("factor", product).select(*cells.columns, "factor")

    for _ in range(rounds):
        off = 0.0
        for d in dims:
            now = times(d).groupBy(d).agg(F.sum(F.col("factor") * F.col("t")).alias("now"))
            new = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
            step = parts[d].join(now, d, "left").select(d, "goal", new.alias("new"), F.col(f"_{d}").alias("old"))
            parts[d] = cut(step.select(d, "goal", F.col("new").alias(f"_{d}"), F.when((F.col("goal") > 0) & (F.col("old") > 0), F.col("new") / F.col("old")).otherwise(1.0).alias("ratio")))
            off = max(off, parts[d].agg(F.max(F.abs(F.col("ratio") - 1))).first()[0] or 0.0)
        if off < tol:
            break
    else:
        warnings.warn(f"raking is still off by {off:.2g} after {rounds} rounds", stacklevel=2)
    return times()


def mixed(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    seed: int = 0,
    rate: float = 0.5,
) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, factor, copies, probability, kept, _row) for each input row, ``_row``
    being the row.

    ``factor`` is how often the row is drawn in expectation, ``copies`` how often it is, ``probability`` that with which
    it is drawn at all, and ``kept`` whether it is. ``rate`` is the drawn tokens' share of all tokens, in expectation: at
    0.5 a value can get twice its share before its documents are repeated, at 1 as much is drawn as the table has.
    ``targets`` maps source, lang and topic to shares by value; a dimension that is missing is tempered from the table. A
    value of the table that a given dimension doesn't name is an error, as its documents would all go; 0 says so. Tokens
    are words. A null source, language or topic is a value of its own, written as an empty string; a text without words has no
    weight and its cell's factor (1 where a cell has no tokens). Rows with one id, and repeated rows, are drawn equally
    often where their cells agree; rows with a null id are decided by their text. No rows give no rows.
    """
    given = targets or {}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    tokens = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        tokens.alias("n_tokens"),
        text.alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
    )
    rows = rows.withColumn("topic", form_topic(F.col("_text"), F.col("n_tokens")) if topic is None else F.coalesce(topic.cast("string"), F.lit("")))
    dims = ["source", "lang", "topic"]
    sums = cut(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("t")))
    spark = docs.sparkSession
    for d in given:
        named = spark.createDataFrame([(v,) for v in given[d]], f"{d} string")
        strange = [r[0] for r in sums.where("t > 0").select(d).distinct().join(named, d, "left_anti").limit(5).collect()]
        if strange:
            raise ValueError(f"no target for {d} {', '.join(map(repr, strange))}")
    n, total = sums.agg(F.count("*"), F.coalesce(F.sum("t"), F.lit(0))).first()
    if n <= LOCAL_CELLS:
        cells = sums.orderBy(*dims).toPandas()
        weight = cells["t"].to_numpy(float)
        index, goals = [], []
        for d in dims:
            code, values = cells[d].factorize()
            share = np.bincount(code, weight, len(values)) / max(total, 1)
            index.append(code)
            goals.append(np.array([given[d].get(v, 0.0) for v in values], float) if d in given else np.where(share > 0, share ** TEMPER[d], 0.0))
        cells["factor"] = rake(weight, index, goals)
        table = list(cells[[*dims, "t", "factor"]].itertuples(index=False, name=None))
        raked = spark.createDataFrame([(*map(str, x[:3]), int(x[3]), float(x[4])) for x in table], "source string, lang string, topic string, t long, factor double")
    else:
        tables = {}
        for d in dims:
            share = sums.where("t > 0").groupBy(d).agg((F.sum("t") / F.lit(float(max(total, 1)))).alias("share"))
            if d in given:
                named = spark.createDataFrame([(v, float(x)) for v, x in given[d].items()], f"{d} string, given double")
                share = share.join(named, d, "left").select(d, "share", F.coalesce("given", F.lit(0.0)).alias("goal"))
            else:
                share = share.withColumn("goal", F.pow("share", F.lit(TEMPER[d])))
            whole = share.agg(F.sum("goal")).first()[0]
            tables[d] = share.select(d, (F.col("goal") / F.lit(whole) if whole else F.col("share")).alias("goal"))
        raked = cut(rake_tables(sums, tables))
    mass = raked.agg(F.sum(F.col("factor") * F.col("t"))).first()[0] or 1.0
    chance = raked.select(*dims, F.when(F.col("t") > 0, F.col("factor") * F.lit(rate * float(total) / mass)).otherwise(1.0).alias("factor"))
    if n <= LOCAL_CELLS:
        chance = F.broadcast(chance)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.xxhash64("_text"))), 11) / F.lit(float(1 << 53))
    out = rows.select("doc_id", *dims, "n_tokens", drawn.alias("_u"), "_row").join(chance, dims, "left")
    copies = F.floor("factor") + (F.col("_u") < F.col("factor") - F.floor("factor")).cast("long")
    out = out.withColumn("copies", copies)
    return out.select("doc_id", *dims, "n_tokens", "factor", "copies", F.least("factor", F.lit(1.0)).alias("probability"), (F.col("copies") > 0).alias("kept"), "_row")


def sampled(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as mixed() draws it."""
    drawn = mixed(docs, **how).where("kept").select("_row", "copies")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: how often each document is drawn so that tempered targets are met with as many tokens as the table has."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), rate=1.0).drop("_row")
