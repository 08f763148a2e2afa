"""Mixes sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

1. Words are counted for each cell (source, language, topic). Every value is one of its own (where MOST has a number, the
   values with the most words and those that a target names are, and the others are "other").
2. The cells' words are raked: scaled to the target shares of the sources, then of the languages, then of the topics,
   again and again until no value's share is off by more than ERROR, or SWEEPS times (then a warning says how far off). A cell's weight is its raked words by its words. Up to DRIVER_CELLS cells are raked on the driver;
   more stay a table, and each step joins it with the dimensions' factors and sums it up along one of them.
3. A document is sampled with its cell's probability, by a hash of its id. The expected words are share of all words of
   the cells with a weight, whatever the rarest cell is: each dimension's values get their target's part of them, but at
   most their own words (what is left goes to the others in proportion), and the cells' weights are raked to these with
   probabilities cut at 1. With share None the probability is rate * weight with the largest rate that makes none exceed
   1, so the expected words have the target shares, but one small cell of a large weight can leave few of them; with a
   given rate it is rate * weight cut at 1.

Targets are shares by value (values without one keep none), or, by default, the observed shares to the power TEMPER,
which lifts rare values. Shares are scaled to the sum of 1. Words stand for tokens, and topics are told from fixed strings in
the text, unless columns of docs give them (tokens_col, topic_col).

Defined cases: null text counts as empty; a null source or language is the value "unknown"; an id that is repeated is
sampled with all its rows or none (each row by the probability of its own cell), a null id is hashed as the empty text;
a cell without words has weight 1; an empty table gives no rows; the other columns are kept, and those named like new
ones are replaced.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

MOST, TEMPER, SWEEPS, ERROR = {"source": None, "lang": None, "topic": None}, 0.7, 100, 1e-9
#: Sweeps with probabilities that are cut at 1.
CAPPED_SWEEPS = 25
#: Of the words, what is expected to be kept.
SHARE = 0.8
#: Sweeps of the query, without a look at the error: its SQL can't stop early.
SQL_SWEEPS = 40
#: Cells that the driver rakes at most.
DRIVER_CELLS = 50_000
#: Cells of which the table is broadcast at most; more are joined by a shuffle.
BROADCAST_CELLS = 50_000
# The strings that tell topics; the first that applies.
TOPICS = (("table", (" | ",)), ("legal", ("icense", "opyright")), ("contact", ("@",)), ("web", ("http", "www.")))
WORD = r"[^\x20\x09-\x0D]+"
NEW = ("topic", "n_words", "weight", "probability", "sampled")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, strings in reversed(TOPICS):
        found = F.lit(False)
        for s in strings:
            found = found | F.contains(text, F.lit(s))
        out = F.when(found, F.lit(name)).otherwise(out)
    return out


def uniform(id_: Column, salt: str) -> Column:
    """A number in [0, 1) by the hash of an id: 52 bits."""
    digest = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(cells: dict[tuple, float], targets: list[dict], sweeps: int = SWEEPS, error: float = ERROR) -> dict[tuple, float]:
    """Cells scaled so that their shares along each dimension come to the targets'."""
    total, off = sum(cells.values()), 0.0
    for _ in range(sweeps):
        off = 0.0
        for k, target in enumerate(targets):
            have: dict = {}
            for cell, x in cells.items():
                have[cell[k]] = have.get(cell[k], 0.0) + x
            off = max([off, *(abs(x / total - target.get(v, 0.0)) for v, x in have.items())]) if total else 0.0
            cells = {cell: x * target.get(cell[k], 0.0) * total / have[cell[k]] if have[cell[k]] else x for cell, x in cells.items()}
        if off <= error:
            break
    _warn(off, error)
    return cells


def _warn(off: float, error: float) -> None:
    if off > error > 0:
        warnings.warn(f"raking has stopped with a share that is off by {off:.2g}: the targets contradict each other, or more sweeps are needed", stacklevel=3)


def filled(have: dict, target: dict, total: float) -> dict:
    """Words of each value: in proportion to the target's shares, at most what it has, total in all if that can be."""
    rate = total
    full: set = set()
    while True:
        new = {v for v, x in have.items() if rate * target.get(v, 0.0) >= x}
        left = sum(target.get(v, 0.0) for v in have if v not in new)
        if new <= full or left <= 0:
            return {v: min(x, rate * target.get(v, 0.0)) for v, x in have.items()}
        full, rate = new, (total - sum(have[v] for v in new)) / left


def capped(cells: dict[tuple, tuple[float, float]], targets: list[dict], share: float, sweeps: int = SWEEPS) -> dict[tuple, float]:
    """Probabilities of cells of (words, raked words) with which share of the words is kept."""
    cells = {cell: x for cell, x in cells.items() if x[0] > 0 and x[1] > 0}
    total = share * sum(words for words, _ in cells.values())
    goals = []
    for k, target in enumerate(targets):
        have: dict = {}
        for cell, (words, _) in cells.items():
            have[cell[k]] = have.get(cell[k], 0.0) + words
        goals.append(filled(have, target, total))
    scale = total / (sum(x for _, x in cells.values()) or 1.0)
    now = {cell: scale * x for cell, (_, x) in cells.items()}
    for _ in range(min(sweeps, CAPPED_SWEEPS)):
        for k, goal in enumerate(goals):
            full, free = dict.fromkeys(goal, 0.0), dict.fromkeys(goal, 0.0)
            for cell, x in now.items():
                if x >= cells[cell][0]:
                    full[cell[k]] += cells[cell][0]
                else:
                    free[cell[k]] += x
            step = {v: _step(goal[v], full[v], free[v]) for v in goal}
            now = {cell: x * step[cell[k]] for cell, x in now.items()}
    return {cell: min(1.0, x / cells[cell][0]) for cell, x in now.items()}


def _step(goal: float, full: float, free: float) -> float:
    """The factor of a value's words, of which some are at their most."""
    if goal <= full:
        return goal / (full + free) if full + free else 1.0
    return (goal - full) / free if free else 1.0


def tempered(cells: dict[tuple, float], k: int, power: float) -> dict:
    have: dict = {}
    for cell, x in cells.items():
        have[cell[k]] = have.get(cell[k], 0.0) + x
    raised = {v: x**power for v, x in have.items() if x}
    return {v: x / sum(raised.values()) for v, x in raised.items()}


def rake_table(cells: DataFrame, targets: dict[str, DataFrame], folder: str, sweeps: int = SWEEPS, error: float = ERROR) -> DataFrame:
    """rake() of a table of cells with words: the cells with x. targets: (value, share) of each dimension."""
    total = cells.agg(F.sum("words")).first()[0] or 0
    factors, off = {dim: None for dim in targets}, 0.0

    def scaled() -> DataFrame:
        out = cells.withColumn("x", F.col("words").cast("double"))
        for dim, factor in factors.items():
            if factor is not None:
                out = out.join(factor.withColumnRenamed("value", dim), dim).withColumn("x", F.col("x") * F.col("factor")).drop("factor")
        return out

    for sweep in range(sweeps):
        off = 0.0
        for dim, target in targets.items():
            have = scaled().groupBy(F.col(dim).alias("value")).agg(F.sum("x").alias("have"))
            step = F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * float(total) / F.col("have")).otherwise(1.0)
            new = have.join(target, "value", "left").select("value", step.alias("step"), F.abs(F.col("have") / (float(total) or 1.0) - F.coalesce("share", F.lit(0.0))).alias("off"))
            old = factors[dim]
            new = new.withColumn("factor", F.col("step")) if old is None else new.join(old, "value").withColumn("factor", F.col("step") * F.col("factor"))
            factors[dim] = common.stage(new.select("value", "factor", "off"), f"{folder}/factors-{dim}-{sweep}")
            off = max(off, factors[dim].agg(F.max("off")).first()[0] or 0.0)
            factors[dim] = factors[dim].drop("off")
        if off <= error:
            break
    _warn(off, error)
    return scaled()


def capped_table(cells: DataFrame, targets: dict[str, DataFrame], share: float, folder: str, sweeps: int = SWEEPS) -> DataFrame:
    """capped() of a table of cells with words and weight: the cells with probability."""
    live = common.stage(cells.filter("words > 0 AND weight > 0").withColumn("words", F.col("words").cast("double")), f"{folder}/live")
    words, raked = live.agg(F.sum("words"), F.sum(F.col("words") * F.col("weight"))).first()
    total, factors, goals = share * (words or 0.0), {}, {}
    for dim, target in targets.items():
        have = live.groupBy(F.col(dim).alias("value")).agg(F.sum("words").alias("have")).join(target, "value", "left")
        have = common.stage(have.select("value", "have", F.coalesce("share", F.lit(0.0)).alias("share")), f"{folder}/have-{dim}")
        rate, n_full = total, 0
        while True:
            is_full = F.lit(float(rate)) * F.col("share") >= F.col("have")
            n, full, left = have.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("have"))), F.sum(F.when(~is_full, F.col("share")))).first()
            if n <= n_full or not left:
                break
            n_full, rate = n, (total - full) / left
        goals[dim] = have.select("value", F.least("have", F.lit(float(rate)) * F.col("share")).alias("goal"))

    def scaled() -> DataFrame:
        out = live.withColumn("x", F.col("words") * F.col("weight") * F.lit(float(total / (raked or 1.0))))
        for dim, factor in factors.items():
            out = out.join(factor.withColumnRenamed("value", dim), dim).withColumn("x", F.col("x") * F.col("factor")).drop("factor")
        return out

    for sweep in range(min(sweeps, CAPPED_SWEEPS)):
        for dim, goal in goals.items():
            at_most = F.col("x") >= F.col("words")
            sums = scaled().groupBy(F.col(dim).alias("value")).agg(F.sum(F.when(at_most, F.col("words")).otherwise(0.0)).alias("full"), F.sum(F.when(at_most, 0.0).otherwise(F.col("x"))).alias("free"))
            all_ = F.col("full") + F.col("free")
            step = F.when(F.col("goal") <= F.col("full"), F.when(all_ > 0, F.col("goal") / all_).otherwise(1.0)).when(F.col("free") > 0, (F.col("goal") - F.col("full")) / F.col("free")).otherwise(1.0)
            new = sums.join(goal, "value").select("value", step.alias("step"))
            old = factors.get(dim)
            new = new.withColumn("factor", F.col("step")) if old is None else new.join(old, "value").withColumn("factor", F.col("step") * F.col("factor"))
            factors[dim] = common.stage(new.select("value", "factor"), f"{folder}/capped-{dim}-{sweep}")
    found = scaled().select(*targets, F.least(F.lit(1.0), F.col("x") / F.col("words")).alias("probability"))
    return cells.join(found, list(targets), "left").withColumn("probability", F.coalesce("probability", F.when(F.col("words") > 0, 0.0).otherwise(1.0)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, rate: float | None = None, share: float | None = SHARE, salt: str = "mix", topic_col: str | None = None, tokens_col: str | None = None, sweeps: int = SWEEPS, error: float = ERROR) -> DataFrame:
    """docs with topic, n_words, weight, probability and sampled. targets: shares by "source", "lang" or "topic"."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = [c for c in docs.columns if c not in NEW]
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    topic = value(topic_col) if topic_col else topic_of(text)
    n_words = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else F.regexp_count(text, F.lit(WORD)).cast("long")
    rows = docs.select(
        F.struct(*names).alias("row"), F.col(id_col).alias("id"), value(source_col).alias("source"), value(lang_col).alias("lang"),
        topic.alias("topic"), n_words.alias("n_words"),
    )
    folder = common.work_dir(spark, "mix")
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_words").alias("words"))
    cells = common.stage(cells, f"{folder}/cells")  # as many rows as there are distinct triples
    kept = {}
    for dim, most in MOST.items():
        if most is None:
            kept[dim] = None
            continue
        top = cells.groupBy(dim).agg(F.sum("words").alias("words")).orderBy(F.desc("words"), dim).limit(most + 1).collect()
        kept[dim] = None if len(top) <= most else sorted({r[dim] for r in top[:most]} | set((targets or {}).get(dim) or ()))
    named = lambda dim: F.col(dim) if kept[dim] is None else F.when(F.col(dim).isin(kept[dim]), F.col(dim)).otherwise("other")
    dims = [named(dim).alias(dim) for dim in MOST]
    cells = common.stage(cells.select(*dims, "words").groupBy(*MOST).agg(F.sum("words").alias("words")), f"{folder}/named")
    n_cells, own_targets = cells.count(), targets or {}
    if n_cells <= DRIVER_CELLS:
        found = {(r.source, r.lang, r.topic): float(r.words) for r in cells.collect()}
        goals = []
        for k, dim in enumerate(MOST):
            own = own_targets.get(dim)
            goals.append({v: x / sum(own.values()) for v, x in own.items()} if own else tempered(found, k, temper))
        raked = rake(dict(found), goals, sweeps, error)
        weights = sorted((*cell, raked[cell] / x if x else 1.0) for cell, x in found.items())
        if rate is None and share is not None:
            kept_of = capped({cell: (x, raked[cell]) for cell, x in found.items()}, goals, share)
            weights = [(*cell, w, kept_of.get(cell, 0.0 if found[cell] else 1.0)) for *cell, w in weights for cell in [tuple(cell)]]
        else:
            scale = 1 / max((w for *_, w in weights), default=1.0) if rate is None else rate
            weights = [(*cell, w, min(1.0, scale * w)) for *cell, w in weights]
        table = spark.createDataFrame(weights, "source string, lang string, topic string, weight double, probability double")
    else:
        goals = {}
        for dim in MOST:
            own = own_targets.get(dim)
            if own:
                goals[dim] = spark.createDataFrame([(v, x / sum(own.values())) for v, x in own.items()], "value string, share double")
                continue
            raised = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("words").alias("words")).filter("words > 0").select("value", F.pow("words", F.lit(temper)).alias("share"))
            raised = common.stage(raised, f"{folder}/raised-{dim}")
            goals[dim] = raised.select("value", (F.col("share") / (raised.agg(F.sum("share")).first()[0] or 1.0)).alias("share"))
        table = rake_table(cells, goals, folder, sweeps, error).select(*MOST, "words", F.when(F.col("words") > 0, F.col("x") / F.col("words")).otherwise(1.0).alias("weight"))
        table = common.stage(table, f"{folder}/weights")
        if rate is None and share is not None:
            table = common.stage(capped_table(table, goals, share, folder), f"{folder}/probabilities")
        else:
            scale = 1 / table.agg(F.max("weight")).first()[0] if rate is None else rate
            table = table.withColumn("probability", F.least(F.lit(1.0), F.lit(float(scale)) * F.col("weight")))
        table = table.drop("words")
    if n_cells <= BROADCAST_CELLS:
        table = F.broadcast(table)
    joined = rows.select("row", "id", *dims, "n_words", F.col("topic").alias("own_topic")).join(table, list(MOST))
    sampled = (uniform(F.col("id"), salt) < F.col("probability")).alias("sampled")
    return joined.select(*(F.col(f"row.`{c}`") for c in names), F.col("own_topic").alias("topic"), "n_words", "weight", "probability", sampled)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = mix(common.spread(docs), share=None, sweeps=SQL_SWEEPS, error=0.0)
    return out.select("doc_id", "source", "lang", "topic", "n_words", F.round("weight", 8).alias("weight"), F.round("probability", 8).alias("probability"), "sampled")


def _sql() -> str:
    topics = " ".join("WHEN " + " OR ".join(f"contains(t, '{s}')" for s in strings) + f" THEN '{name}'" for name, strings in TOPICS)
    tempered_ = lambda dim: f"{dim}_t AS (SELECT {dim}, pow(sum(words), {TEMPER}) / sum(pow(sum(words), {TEMPER})) OVER () AS share FROM cells GROUP BY {dim} HAVING sum(words) > 0)"
    step = "SELECT source, lang, topic, words, x FROM it"
    for dim in MOST:
        step = f"SELECT c.source, c.lang, c.topic, c.words, c.x * g.share * total / sum(c.x) OVER (PARTITION BY c.{dim}) AS x FROM ({step}) AS c JOIN {dim}_t AS g ON g.{dim} = c.{dim}, total"
    sweeps, before = [], "SELECT *, words AS x FROM (SELECT source, lang, topic, CAST(words AS DOUBLE) AS words FROM cells WHERE words > 0)"
    for k in range(SQL_SWEEPS):
        sweeps.append(f"s{k} AS MATERIALIZED ({step.replace('FROM it', f'FROM ({before})')})")
        before = f"SELECT * FROM s{k}"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l,
         CASE {topics} ELSE 'prose' END AS topic, len(regexp_extract_all(t, '{WORD}')) AS n_words
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), cells AS MATERIALIZED (SELECT s AS source, l AS lang, topic, sum(n_words) AS words FROM d GROUP BY ALL),
total AS (SELECT CAST(sum(words) AS DOUBLE) AS total FROM cells), {", ".join(tempered_(dim) for dim in MOST)},
{", ".join(sweeps)},
w AS MATERIALIZED (SELECT c.source, c.lang, c.topic, coalesce(x.x / x.words, 1.0) AS weight
  FROM cells AS c LEFT JOIN ({before}) AS x ON x.source = c.source AND x.lang = c.lang AND x.topic = c.topic)
SELECT doc_id, d.source, d.lang, d.topic, n_words, round(weight, 8) AS weight, round(weight / m, 8) AS probability,
       CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < weight / m AS sampled
FROM d JOIN w ON w.source = d.s AND w.lang = d.l AND w.topic = d.topic, (SELECT max(weight) AS m FROM w)
"""


OP5_SQL = _sql()
