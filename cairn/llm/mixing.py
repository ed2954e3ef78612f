"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic). The cells' token weights are raked until their margins
meet the targets of every dimension to within TOLERANCE (contradictory targets have no solution: raking ends when their
margins no longer change, or after MOST_SWEEPS sweeps); a document of a cell is then sampled with the probability that the raked weight asks for, calibrated so that the expected tokens are the wanted fraction of all and no probability
exceeds one (cells that would are kept whole, and the rest is scaled up for them).

Raking needs the cells only. Up to CELLS_ON_DRIVER cells (counted first) it runs on the driver, beyond that as
joins and map-side combined sums; both take the same steps. Targets not given are tempered shares: tokens to
the power of TEMPER.

Defined results: null source or language is a value of its own; null text has no token; documents without tokens weigh nothing and
are not sampled; rows with equal ids share their draw; an empty table gives an empty table; other columns pass
unchanged, and columns of the result's names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, table

DIMS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.7}
FRACTION = 0.5
#: Greatest difference of a margin from its target at which raking ends, and the most sweeps.
TOLERANCE, MOST_SWEEPS = 1e-13, 30
SEED = "mix-1"
CELLS_ON_DRIVER = 200_000
#: Topic by the first rule that holds; SQL over text and n_tokens that Spark and DuckDB both read.
TOPICS = (
    ("table", "instr(text, '|') > 0"),
    ("contact", "instr(text, '@') > 0"),
    ("licence", "instr(text, 'icense') > 0"),
    ("note", "n_tokens < 60"),
    ("essay", "n_tokens >= 600"),
)
REST = "prose"


def topic_sql(topics: tuple[tuple[str, str], ...] = TOPICS) -> str:
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in topics) + f" ELSE '{REST}' END"


def with_cells(docs: DataFrame, topics: tuple[tuple[str, str], ...] = TOPICS) -> DataFrame:
    """docs with n_tokens and topic; both are computed from the whole text."""
    docs = docs.drop("n_tokens", "topic")
    return docs.withColumn("n_tokens", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")).withColumn("topic", F.expr(topic_sql(topics)))


def _key(c: str) -> Column:
    """Null as a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def cells_of(docs: DataFrame) -> DataFrame:
    """(source, lang, topic as keys, n): tokens by cell, without cells that have none."""
    return docs.groupBy(*[_key(d).alias(d) for d in DIMS]).agg(F.sum("n_tokens").alias("n")).where("n > 0")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, share): margins of the tokens to a power, as shares."""
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("n").cast("double"), F.lit(power)).alias("p"))
    whole = sums.agg(F.sum("p")).first()[0] or 1.0
    return sums.select("value", (F.col("p") / F.lit(whole)).alias("share"))


def rake_on_driver(keys: list[np.ndarray], n: np.ndarray, targets: list[np.ndarray], sweeps: int = MOST_SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights that sum to 1. keys: by dimension, each cell's value number; targets: by dimension, shares by number."""
    w, last = n / n.sum(), np.inf
    for _ in range(sweeps):
        off = 0.0
        for k, t in zip(keys, targets, strict=True):
            sums = np.bincount(k, weights=w, minlength=len(t))
            # values that have a target but no cell can't be reached: the others share it
            reachable = np.where(sums > 0, t, 0)
            goal = reachable / (reachable.sum() or 1.0)
            off = max(off, float(np.abs(goal - sums).max()))
            w = w * (np.divide(goal, sums, out=np.zeros_like(sums), where=sums > 0))[k]
        # measured as each dimension's turn came; what no longer changes won't meet contradictory targets any better
        if off <= tolerance or abs(last - off) <= tolerance:
            break
        last = off
    return w


def calibrate(n: np.ndarray, w: np.ndarray, fraction: float) -> np.ndarray:
    """Probabilities p <= 1 in proportion to w / n where below 1, with sum(n p) = fraction x sum(n), or all that w > 0 has."""
    budget, r = fraction * n.sum(), w / n
    order = np.lexsort((np.arange(len(n)), -r))
    whole_n, whole_w = np.concatenate([[0], np.cumsum(n[order])]), np.concatenate([[0], np.cumsum(w[order])])
    for k in range(len(n)):
        rest = w.sum() - whole_w[k]
        scale = max(0.0, budget - whole_n[k]) / rest if rest > 1e-15 else np.inf
        if scale * r[order[k]] <= 1 or whole_n[k] >= budget:
            return np.minimum(1, np.where(np.isin(np.arange(len(n)), order[:k]), 1.0, scale * r))
    return np.where(w > 0, 1.0, 0.0)


def probabilities(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION, sweeps: int = MOST_SWEEPS, bound: int = CELLS_ON_DRIVER) -> tuple[DataFrame, bool]:
    """(source, lang, topic, n, weight, prob) by cell, and whether the table is within the bound."""
    cells = keep(cells, "cells")
    small = cells.count() <= bound
    if small and all(t.count() <= bound for t in targets.values()):
        rows = cells.orderBy(*DIMS).toPandas()
        n = rows["n"].to_numpy(float)
        keys, shares = [], []
        for d in DIMS:
            t = targets[d].toPandas()
            number = {v: i for i, v in enumerate(sorted(set(rows[d]) | set(t["value"])))}
            share = np.zeros(len(number))
            for v, s in zip(t["value"], t["share"], strict=True):
                share[number[v]] = s
            keys.append(rows[d].map(number).to_numpy(int))
            shares.append(share)
        w = rake_on_driver(keys, n, shares, sweeps) if len(n) else n
        p = calibrate(n, w, fraction) if len(n) else n
        out = [(*x, float(a), float(b)) for *x, a, b in zip(*[rows[d] for d in DIMS], rows["n"].astype(int).tolist(), w, p, strict=True)]
        return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, n bigint, weight double, prob double"), True
    now = cells.withColumn("weight", F.col("n").cast("double"))
    whole = cells.agg(F.sum("n")).first()[0] or 1
    now = now.withColumn("weight", F.col("weight") / F.lit(float(whole)))
    last = np.inf
    for _ in range(sweeps):
        off = 0.0
        for d in DIMS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum")).join(targets[d].withColumnRenamed("value", d), d, "left").withColumn("share", F.when(F.col("sum") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
            sums = keep(sums, "margins")
            reachable = sums.agg(F.sum("share")).first()[0] or 1.0
            goal = F.col("share") / F.lit(reachable)
            off = max(off, sums.agg(F.max(F.abs(goal - F.col("sum")))).first()[0] or 0.0)
            sums = sums.select(d, F.when(F.col("sum") > 0, goal / F.col("sum")).otherwise(0.0).alias("by"))
            now = now.join(sums, d, "left").withColumn("weight", F.col("weight") * F.coalesce("by", F.lit(0.0))).drop("by")
        now = keep(now, "raked")
        if off <= TOLERANCE or abs(last - off) <= TOLERANCE:
            break
        last = off
    total_n, total_w = now.agg(F.sum("n"), F.sum("weight")).first()
    budget, scale = fraction * total_n, None
    ratio = F.col("weight") / F.col("n")
    while True:
        # cells that the last scale would keep with more than all their documents are kept whole
        whole = F.lit(False) if scale is None else ratio * scale > 1
        held_n, held_w = now.agg(F.coalesce(F.sum(F.when(whole, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(whole, F.col("weight"))), F.lit(0.0))).first()
        rest = total_w - held_w
        new = max(0.0, budget - held_n) / rest if rest > 1e-15 else scale
        if scale is not None and new <= scale * (1 + 1e-12):
            break
        scale = new
    return now.withColumn("prob", F.least(F.lit(1.0), ratio * scale)).select(*DIMS, "n", "weight", "prob"), False


def draw(doc: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that the id and the seed decide."""
    text = F.concat(F.coalesce(F.col(doc).cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, doc: str = "doc_id", targets: dict[str, dict[str | None, float]] | None = None, fraction: float = FRACTION, sweeps: int = MOST_SWEEPS, bound: int = CELLS_ON_DRIVER, celled: bool = False, topic: str | None = None) -> DataFrame:
    """docs with n_tokens, topic, weight (the cell's share of the target tokens), prob and kept.

    targets: by dimension, value to weight; dimensions without one take tempered shares. celled: docs already has
    n_tokens and topic. topic: a column of docs that names the topic, in place of the rules of TOPICS.
    """
    docs = docs.drop("weight", "prob", "kept")
    if topic is not None and not celled:
        held = fresh(docs, "own_topic")
        docs = with_cells(docs.withColumn(held, F.col(topic))).withColumn("topic", F.col(held).cast("string")).drop(held)
    else:
        docs = docs if celled else with_cells(docs)
    spark, cells = docs.sparkSession, keep(cells_of(docs), "cells")
    goals = {}
    for d in DIMS:
        own = (targets or {}).get(d)
        if own is None:
            goals[d] = tempered(cells, d, TEMPER[d])
        else:
            goals[d] = spark.createDataFrame([("null" if k is None else f"={k}", float(v)) for k, v in own.items()], "value string, share double")
    table_, small = probabilities(cells, goals, fraction, sweeps, bound)
    of = {d: fresh(docs, f"of_{d}") for d in DIMS}
    named = table_.select(*[F.col(d).alias(of[d]) for d in DIMS], "weight", "prob")
    # at most CELLS_ON_DRIVER rows are broadcast; a larger table is joined by its keys
    out = docs.join(F.broadcast(named) if small else named, [_key(d) == F.col(of[d]) for d in DIMS], "left").drop(*of.values())
    out = out.withColumn("prob", F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return out.withColumn("kept", draw(doc) < F.col("prob"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_cells(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")).drop("text")
    # the texts are read once: what follows needs counts and topics only
    out = mix(keep(docs, "celled"), celled=True)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("prob", 6).alias("prob"), "kept")


#: SQL has no loop here that ends by itself; margins settle long before.
ORACLE_SWEEPS = 24


def _oracle(select: str, documents: str = "documents") -> str:
    """Raking with one CTE a step, then calibration by running sums over the cells in order of weight by token."""
    ctes = [
        f"d0 AS (SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM {documents})",
        f"d AS (SELECT * EXCLUDE (text), {topic_sql()} AS topic, coalesce('=' || source, 'null') AS ks, coalesce('=' || lang, 'null') AS kl FROM d0)",
        "c AS (SELECT ks AS source, kl AS lang, '=' || topic AS topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    ctes += [f"t_{x} AS MATERIALIZED (SELECT {x}, p / sum(p) OVER () AS share FROM (SELECT {x}, pow(sum(n), {TEMPER[x]}) AS p FROM c GROUP BY {x}))" for x in DIMS]
    ctes.append("w0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS w FROM c)")
    last = "w0"
    for k in range(ORACLE_SWEEPS):
        for x in DIMS:
            ctes.append(f"w{k}_{x} AS MATERIALIZED (SELECT a.* REPLACE (a.w * t.share / sum(a.w) OVER (PARTITION BY a.{x}) AS w) FROM {last} a JOIN t_{x} t ON a.{x} = t.{x})")
            last = f"w{k}_{x}"
    ctes += [
        f"o AS MATERIALIZED (SELECT *, w / n AS r, coalesce(sum(n) OVER s, 0) AS whole_n, coalesce(sum(w) OVER s, 0) AS whole_w, row_number() OVER (ORDER BY w / n DESC, source, lang, topic) AS k FROM {last} WINDOW s AS (ORDER BY w / n DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        f"b AS (SELECT {FRACTION} * sum(n) AS budget, sum(w) AS all_w FROM o)",
        "g AS (SELECT o.*, greatest(0, budget - whole_n) / (all_w - whole_w) AS scale FROM o, b)",
        "f AS (SELECT k AS first_k, scale AS top_scale FROM g, b WHERE scale * r <= 1 OR whole_n >= budget ORDER BY k LIMIT 1)",
        "p AS (SELECT source, lang, topic, w, CASE WHEN k < first_k THEN 1.0 ELSE least(1.0, top_scale * r) END AS prob FROM o, f)",
        f"m AS (SELECT d.*, coalesce(p.w, 0) AS weight, CASE WHEN n_tokens > 0 THEN coalesce(p.prob, 0) ELSE 0 END AS prob, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM d LEFT JOIN p ON d.ks = p.source AND d.kl = p.lang AND '=' || d.topic = p.topic)",
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + select


ORACLE = _oracle("SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(prob, 6) AS prob, u < prob AS kept FROM m")
