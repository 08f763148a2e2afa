"""Finds secrets with a trigram inverted index and SQL functions only.

1. For each rule, a Boolean trigram query is derived from its regular expression: every run of the expression that can only
   be a few strings of three characters or more has to be there, that is, all trigrams of one of its strings (in lower
   case). The query is the AND of its runs. Rules without such a run have no query.
2. The inverted index holds postings (trigram, text) for given trigrams, by default those that the rules' queries ask for
   (an index of all trigrams would be larger than the texts); texts are named by their MD5 digest, so copies are one
   entry of a posting list. It is written to the shared folder, sorted by trigram, and can be used again: of another
   rule, the runs whose trigrams the index has are asked for, and a rule without one scans fully.
3. Postings are intersected: for each text and string, the bits of the trigrams that it has are or-ed (with map-side
   parts; no posting list is ever collected), a string whose bits are complete stands for its run, and a text with all
   of a rule's runs is a candidate of the rule.
4. Candidates are verified with the rule's expression. They reach their texts as a table of at most BROADCAST_ROWS digests
   that is broadcast, or by a shuffle if there are more. Rules without a query scan all texts.

Defined cases: null text counts as empty and has no span; rows are independent, so ties and repeated rows, null ids and
very long texts need no care; an empty table gives no rows; the other columns are kept, and one named spans is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping, whose group has at least least characters. The pattern is kept
    to what Java, RE2 and Python read alike; any_case makes A-Z and a-z in it match either."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
# Formats that providers publish.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----", 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 30),
)
RULES = BASE + MORE

# --------------------------------------------------------------------------------------------------- trigram queries

#: Digests of candidates that are broadcast, some 50 bytes each.
BROADCAST_ROWS = 1 << 20
#: A run of more strings than this, or a class of more characters, ends a run.
FEW = 64


def _finite(sequence) -> set[str] | None:
    """All strings that a parsed sequence matches, if they are few."""
    found = {""}
    for op, value in sequence:
        own = _strings(str(op), value)
        if own is None or len(own) * len(found) > FEW:
            return None
        found = {a + b for a in found for b in own}
    return found


def _strings(op: str, value) -> set[str] | None:
    if op == "LITERAL":
        return {chr(value)}
    if op == "AT":
        return {""}
    if op == "IN":
        out: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                out.add(chr(x))
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                out.update(map(chr, range(x[0], x[1] + 1)))
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _finite(value[-1])
    if op == "BRANCH":
        parts = [_finite(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT":
        low, high, inner = value
        own = _finite(inner)
        if own is None or int(high) > 8 or len(own) ** int(high) > FEW:
            return None
        return set().union(*(reduce(lambda a, _: {x + y for x in a for y in own}, range(n), {""}) for n in range(low, int(high) + 1)))
    return None


#: A run of a query: in a text, all trigrams of one of the sets have to be.
Run = tuple[frozenset[str], ...]


def trigram_query(pattern: str) -> list[Run]:
    """The runs that a text which the pattern matches has, in lower case; none if nothing has to be there."""
    runs, run = [], {""}
    for op, value in re._parser.parse(pattern):
        own = _strings(str(op), value)
        if own is not None and len(own) * len(run) <= FEW:
            run = {a + b for a in run for b in own}
        else:
            runs.append(run)
            run = own or {""}
    runs.append(run)
    query = []
    for strings in runs:
        if min(map(len, strings)) >= 3:
            lowered = {s.lower() for s in strings}
            needed = [s for s in sorted(lowered) if not any(t != s and t in s for t in lowered)]
            query.append(tuple(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in needed))
    return query


def grams_of(queries: list[list[Run]]) -> list[str]:
    return sorted({g for query in queries for run in query for need in run for g in need})


# -------------------------------------------------------------------------------------------------------- the operator


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


@dataclass(frozen=True)
class Index:
    """Postings (gram, key): the number of a trigram in grams, and a text's digest."""

    postings: DataFrame
    grams: tuple[str, ...]


def index_of(docs: DataFrame, grams: list[str], *, text_col: str = "text") -> Index:
    """An inverted index of the texts for these trigrams, of three characters without capitals each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = common.spread(docs.select(text.alias("text"))).select(_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams)), F.lit(None).cast("int")))
    rows = low.select("key", F.explode(has).alias("gram")).select("gram", "key").distinct().sortWithinPartitions("gram")
    return Index(common.stage(rows, f"{common.work_dir(docs.sparkSession, 'secrets')}/index"), tuple(grams))


def known_runs(query: list[Run], grams: tuple[str, ...]) -> list[Run]:
    """The runs that an index of these trigrams can answer."""
    return [run for run in query if all(need <= set(grams) for need in run)]


def candidates(index: Index, queries: dict[int, list[Run]]) -> DataFrame:
    """(key, rules): a bit for each rule of which the text is a candidate."""
    terms = []
    for rule, query in queries.items():
        for r, run in enumerate(query):
            for k, need in enumerate(run):
                terms += [(index.grams.index(g), rule, r, k, 1 << b, (1 << len(need)) - 1, (1 << len(query)) - 1) for b, g in enumerate(sorted(need))]
    table = index.postings.sparkSession.createDataFrame(terms, "gram int, rule int, run int, string int, bit long, full long, runs long")
    met = index.postings.join(F.broadcast(table), "gram")  # as many rows as the rules' strings have trigrams
    found = met.groupBy("key", "rule", "run", "string", "full", "runs").agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    found = found.groupBy("key", "rule", "runs").agg(F.bit_or(F.expr("shiftleft(1L, run)")).alias("bits")).filter("bits = runs")
    return found.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind, end) in code points, end exclusive; kind is the rule's number."""
    pattern = F.lit(rule.java)
    pieces, whole = F.split(text, rule.java, -1), F.regexp_extract_all(text, pattern, 0)
    parts = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, rule.group)
    sizes = F.transform(F.arrays_zip(pieces.alias("p"), whole.alias("w"), parts.alias("g")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["w"]).alias("w"), F.length(x["g"]).alias("g")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["p"]
        new = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["w"]).alias("end")))
        return F.struct(
            (start + F.coalesce(x["w"], F.lit(0))).alias("at"),
            F.when(x["g"] >= rule.least, F.concat(state["out"], new)).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])


def scan(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, index: Index | None = None) -> DataFrame:
    """docs with spans, an array of (start, kind, end) by start, then by the rules' order; kind is the rule's number. index:
    one of these texts, else it is made for the rules."""
    names = [c for c in docs.columns if c != "spans"]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = common.spread(docs.select(F.struct(*names).alias("row"), text.alias("text")))
    asked = {k: trigram_query(rule.pattern) for k, rule in enumerate(rules)}
    index = index or index_of(docs, grams_of(list(asked.values())), text_col=text_col)
    queries = {k: runs for k, query in asked.items() if (runs := known_runs(query, index.grams))}
    chosen = common.stage(candidates(index, queries), f"{common.work_dir(docs.sparkSession, 'secrets')}/candidates")
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    keyed = rows.withColumn("key", _key(F.col("text"))).join(chosen, "key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        wanted = F.col("rules").bitwiseAND(F.lit(1 << k)) != 0 if k in queries else F.col("text").rlike(rule.java)
        found.append(F.when(wanted, spans_of(F.col("text"), rule, k)).otherwise(none))
    spans = F.array_sort(F.concat(*found))
    return keyed.select(*(F.col(f"row.`{c}`") for c in names), spans.alias("spans"))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same by RE2: lengths of what stands between matches and of matches, summed up."""

    def pattern(rule: Rule) -> str:
        if not rule.any_case:
            return rule.pattern.replace("'", "''")
        head, _, tail = rule.pattern.partition(")")
        return ("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + ")" + tail).replace("'", "''")

    parts = []
    for k, rule in enumerate(rules):
        p = pattern(rule)
        parts.append(f"""
  SELECT k, {k} AS kind, '{rule.kind}' AS name, i, CAST(list_sum(p[1:i]) + coalesce(list_sum(w[1:i-1]), 0) AS BIGINT) AS a,
         CAST(list_sum(p[1:i]) + list_sum(w[1:i]) AS BIGINT) AS b
  FROM (SELECT k, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS p,
               list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS w,
               list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x)) AS g
        FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(w) + 1)) AS u(i)
  WHERE g[i] >= {rule.least}""")
    join = "string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    counts = ", ".join(f"count(*) FILTER (WHERE name = '{rule.kind}') AS n_{rule.kind}" for rule in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}
), g AS (SELECT k, {counts}, {join} FILTER (WHERE kind < {len(BASE)}) AS base, {join} AS spans FROM s GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (k)
"""


OP2_SQL = _sql()
