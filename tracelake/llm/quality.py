"""Quality rules as a short-circuit cascade of column expressions.

Each rule rejects a text by an expression over the text alone. The cost of a rule (timed, without what a job
costs anyway) and the share that it rejects of what earlier rules leave are estimated on a sample; rules run
in descending order of rejection per cost inside one CASE expression, so a text that a cheap rule rejects never reaches a dear one. The order
changes the time and which rule is named first, never the verdict: a text is kept if no rule rejects it.

Words are runs of other signs than the six ASCII white-space characters; lines end at line feeds.
Defined results: null and empty texts have no words and are rejected as too short; repeated rows are
judged each; an empty table gives no rows and the rules keep their given order; other columns pass.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import free_name, let, table, text_of

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
SAMPLE_ROWS = 2000
ROUNDS = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more among the words ``w``."""

    def covered(places: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(2), F.size(places)), lambda k: F.least(F.lit(window), F.get(places, k - 1) - F.get(places, k - 2)))
        return F.when(F.size(places) == 0, F.lit(0)).when(F.size(places) == 1, F.lit(window)).otherwise(
            F.aggregate(gaps, F.lit(window), lambda a, x: a + x)
        )

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda k, j: F.get(s, k)["h"] == F.get(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & F.coalesce(same(k, k - 1), F.lit(False))) | ((k < last) & F.coalesce(same(k, k + 1), F.lit(False))))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(repeated(s), covered))
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))
    return F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measures(text: Column) -> Column:
    """A struct of the base measures of a text."""
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols(text).alias("n_symbols"), let(lines_with_words(text), dup_lines).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Rule:
    """``rejects(text)``: true where the rule rejects."""

    name: str
    rejects: Callable[[Column], Column]


def _upper(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _n(text: Column) -> Column:
    return F.size(words(text))


RULES = (
    Rule("too_short", lambda t: _n(t) < 10),
    Rule("repeats", lambda t: let(words(t), lambda w: repeat_words(w) * 100 > F.size(w) * 20)),
    Rule("symbols", lambda t: symbols(t) * 4 > _n(t)),
    Rule("dup_lines", lambda t: let(lines_with_words(t), lambda x: dup_lines(x) * 2 > F.size(x))),
    Rule("shouting", lambda t: _upper(t) * 2 > _letters(t)),
    Rule("exclaiming", lambda t: (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))) * 4 > _n(t)),
    Rule("word_length", lambda t: let(words(t), lambda w: let(F.length(F.array_join(w, "")), lambda c: (c < F.size(w) * 2) | (c > F.size(w) * 20)))),
    Rule("few_letters", lambda t: _letters(t) * 2 < F.length(F.regexp_replace(t, SPACE, ""))),
)


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share it rejects of what earlier rules leave, seconds a row) on at most about ``sample_rows`` rows, in the cascade's order.

    Rules are timed in turn, ``ROUNDS`` times after a round that compiles them; a rule's cost is its least time
    beyond that of a job that only reads the texts. The rule with the most rejections per cost among the rows
    that are left comes next. The sample sets the order only; its bound keeps the estimate's cost fixed.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    text = F.col("t")
    rejects = [F.coalesce(r.rejects(text), F.lit(True)) for r in rules]
    sample = docs.select(text_of(text_col).alias("t")).sample(False, min(1.0, sample_rows / total), 7).persist()
    try:
        # one row for each set of rules that reject together: bounded by the rules
        verdicts = sample.select(F.array(*rejects).alias("v")).groupBy("v").count().collect()
        rows = max(1, sum(r["count"] for r in verdicts))
        jobs = [F.count_if(F.length(text) < 0), *map(F.count_if, rejects)]
        least = [math.inf] * len(jobs)
        for turn in range(1 + ROUNDS):
            for k, job in enumerate(jobs):
                began = time.perf_counter()
                sample.agg(job).first()
                if turn:
                    least[k] = min(least[k], time.perf_counter() - began)
    finally:
        sample.unpersist()
    cost = [max(t - least[0], least[0] / 100) / rows for t in least[1:]]
    left, open_rules, out = [(r["v"], r["count"]) for r in verdicts], set(range(len(rules))), []
    while open_rules:
        share = {k: sum(n for v, n in left if v[k]) / max(1, sum(n for _, n in left)) for k in open_rules}
        best = min(open_rules, key=lambda k: (-share[k] / cost[k], cost[k], rules[k].name))
        out.append((rules[best], share[best], cost[best]))
        left = [(v, n) for v, n in left if not v[best]]
        open_rules.remove(best)
    return out


def first_rejection(text: Column, order: list[Rule]) -> Column:
    """The name of the first rule of ``order`` that rejects, else null; later rules are not evaluated."""
    out = F.when(F.coalesce(order[0].rejects(text), F.lit(True)), F.lit(order[0].name))
    for rule in order[1:]:
        out = out.when(F.coalesce(rule.rejects(text), F.lit(True)), F.lit(rule.name))
    return out


def cascade(docs: DataFrame, rules=RULES, text_col: str = "text", out: str | None = None, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """``docs`` with a column that names the rule that rejected the row (null: kept); the column's name."""
    order = [r for r, _, _ in estimate(docs, rules, text_col, sample_rows)]
    name = out or free_name(docs, "rejected_by")
    return docs.withColumn(name, first_rejection(text_of(text_col), order)), name


def keep_good(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their columns."""
    judged, name = cascade(docs, rules, text_col)
    return judged.filter(F.col(name).isNull()).drop(name)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged, name = cascade(docs)
    m = F.col("m")
    failed = (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)
    return judged.select("doc_id", measures(text_of()).alias("m"), F.col(name).alias("rejected_by")).select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i:i+4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
v AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(l) AS lines, length(t) - length(replace(t, '!', '')) AS bangs,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters FROM w LEFT JOIN v USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR n_dup_lines * 2 > lines OR upper * 2 > letters OR bangs * 4 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 20 OR letters * 2 < word_chars) AS kept FROM f
"""
