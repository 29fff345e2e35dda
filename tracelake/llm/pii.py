"""Personal data by weak supervision, in column expressions alone.

Base spans come from four patterns with checks and always stay. Looser patterns give candidates; regex,
checksum, gazetteer and context labelers vote on each (1 yes, 0 no, 2 abstains). Votes are counted by
pattern - a table whose size is bounded by the labelers, not by the corpus - and expectation-maximisation
over those counts estimates each labeler's reliability and each pattern's posterior. The posteriors then
train the span classifier: log-odds of votes and shape features from grouped sums. It judges candidates;
those that it accepts are added. What overlaps a base span is no candidate, so it does not train either.
Labelers see the match, ``BEFORE`` code points before it and ``AFTER`` after it.

Positions are code points. A match's place is found by marking matches in one replacement and summing the
lengths between marks, in blocks, so that many matches cost little more than few. Patterns hold no
construct that backtracks over a long run, and start where a run starts.

Defined results: a null text is empty and has no spans; repeated rows are judged each; an empty table gives
no rows and an untrained classifier that accepts nothing; other columns pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import discard, free_name, let, materialise, table, text_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser shapes: name, kind, pattern.
LOOSE = (
    ("hex", "secret", r"(?<![A-Za-z0-9])[A-Fa-f0-9]{24,}+(?![A-Za-z0-9])"),
    ("assigned", "secret", r"(?<![A-Za-z])(?i:token|secret|password|passwd|api[_-]?key)[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+.-]{12,}+"),
    ("local", "phone", r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("written", "email", rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?{_HOST}++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?{_HOST}++)++"),
    ("ssn", "secret", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
#: What a text must hold for a match of each loose shape.
SIGNS = {"hex": "[A-Fa-f0-9]{24}", "assigned": "[=:]", "local": "[0-9]{3}[ .-][0-9]{4}", "written": r"[\[(](?:at|AT)[\])]", "ssn": "[0-9]{3}-[0-9]{2}-"}
FIELDS = r"(?i)(?:token|secret|passw|key|card|visa|phone|tel|call|mail|contact|account|ssn|login)[^\p{L}]*$"
DOMAINS = r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk)$"
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|commit|sha|md5|checksum|digest|figure|chapter|license)[^\p{L}]*$"
ABSTAIN = 2
LABELERS = ("shape", "checksum", "gazetteer", "against", "edges")
BLOCK = 256
BEFORE, AFTER = 24, 4
#: A trained classifier accepts a span at this posterior.
ACCEPT = 0.5


def _prefix(values: Column, start: Column) -> Column:
    """Sums of the values before each value, from ``start`` on."""
    zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _starts(lengths: Column) -> Column:
    """As ``_prefix`` from 0, in blocks of ``BLOCK``."""

    def blocks(sums: Column) -> Column:
        return let(_prefix(sums, F.lit(0)), lambda at: F.flatten(F.transform(F.sequence(F.lit(1), F.size(sums)), lambda g: _prefix(F.slice(lengths, (g - 1) * BLOCK + 1, BLOCK), F.get(at, g - 1)))))

    groups = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
    sums = F.transform(groups, lambda g: F.aggregate(F.slice(lengths, g * BLOCK + 1, BLOCK), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(lengths) <= BLOCK, _prefix(lengths, F.lit(0))).otherwise(let(sums, blocks))


_MATCH = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def find(text: Column, pattern: str, quick: Column | None = None) -> Column:
    """The matches of ``pattern``, leftmost and not overlapping: start, end, text, and the text around.

    ``text`` must hold no U+0001 and U+0002. ``quick``: false where there can be no match.
    """
    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p, i: F.length(p) - F.when(i > 0, F.lit(1)).otherwise(F.lit(0)))

        def rows(at: Column) -> Column:
            def row(k: Column) -> Column:
                own = F.get(parts, k)
                m = F.substring_index(own, "\x02", 1)
                return F.struct(
                    F.get(at, k).alias("s"), (F.get(at, k) + F.length(m)).alias("e"), m.alias("m"),
                    F.right(F.get(parts, k - 1), F.lit(BEFORE)).alias("before"), F.left(F.substring_index(own, "\x02", -1), F.lit(AFTER)).alias("after"),
                )

            return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), row)

        return F.when(F.size(parts) < 2, F.array().cast(_MATCH)).otherwise(let(let(lengths, _starts), rows))

    found = let(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), spans)
    return found if quick is None else F.when(quick, found).otherwise(F.array().cast(_MATCH))


def _luhn(digits: Column) -> Column:
    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    return let(F.regexp_replace(m, "[ -]+", ""), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))


def _ip(m: Column) -> Column:
    part = lambda x: let(F.regexp_replace(x, "^0+(?=[0-9])", ""), lambda v: F.when(F.length(v) <= 3, v.cast("int") <= 255).otherwise(F.lit(False)))
    return F.forall(F.split(m, r"\."), part)


def _phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]+", "")).between(10, 15)


def plain(text: Column) -> Column:
    """``text`` with the two marks replaced by another control sign, length for length."""
    return F.when(text.rlike("[\x01\x02]"), F.translate(text, "\x01\x02", "\x03\x03")).otherwise(text)


def _passing(check):
    return lambda x: check(x["m"])


def _as_span(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e>> of the base kinds, by start and kind."""
    digit = text.rlike("[0-9]")
    check = {"email": None, "ip": _ip, "card": _card, "phone": _phone}
    quick = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    each = []
    for k, kind in enumerate(BASE_KINDS):
        found = find(text, PATTERNS[kind], quick[kind])
        if check[kind]:
            found = F.filter(found, _passing(check[kind]))
        each.append(F.transform(found, _as_span(k)))
    return F.sort_array(F.flatten(F.array(*each)))


_CAND = "array<struct<s:int,k:int,e:int,shape:string,v:array<int>,f:array<string>>>"


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, F.lit(1)).when(no if no is not None else F.lit(False), F.lit(0)).otherwise(F.lit(ABSTAIN))


def _voted(name: str, kind: str):
    """A loose match as a candidate: the labelers' votes and its shape."""

    def row(x: Column) -> Column:
        m, before, after = x["m"], x["before"], x["after"]
        digits = F.length(F.regexp_replace(m, "[^0-9]+", ""))
        strict = {"hex": F.length(m).isin(32, 40, 64), "assigned": m.rlike("[=:]"), "local": m.startswith("("), "written": m.rlike("[\\[(](?:dot|DOT)"), "ssn": ~m.rlike("^(?:000|666|9)")}[name]
        mixed = (digits > 0) & (digits < F.length(m))
        checksum = {
            "hex": _vote(mixed, ~mixed), "assigned": _vote(digits >= 4, digits == 0), "local": _vote(~m.rlike("^\\(?[01]"), m.rlike("^\\(?(?:000|1)")),
            "written": _vote(F.length(m) > 8), "ssn": _vote(digits == 9, m.rlike("-00-|-0000$")),
        }[name]
        votes = F.array(
            _vote(strict), checksum, _vote(before.rlike(FIELDS) | m.rlike(DOMAINS) | F.lit(name == "assigned")),
            _vote(F.lit(False), before.rlike(AGAINST)), _vote(F.lit(False), before.rlike("[\\p{L}0-9_]$") | after.rlike("^[\\p{L}0-9_]")),
        )
        shape = F.array(
            F.concat(F.lit(f"{name}/length/"), F.floor(F.log2(F.length(m) + F.lit(0.0))).cast("int").cast("string")),
            F.concat(F.lit(f"{name}/digits/"), F.floor(digits * 4 / F.length(m)).cast("int").cast("string")),
        )
        return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(name).alias("shape"), votes.alias("v"), shape.alias("f"))

    return row


def _apart(base: Column):
    return lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))


def candidates(text: Column, base: Column | None = None) -> Column:
    """Loose matches that overlap no base span, with the labelers' votes and shape features. ``base``: the base spans of ``text``, if they are known."""
    found = F.flatten(F.array(*[F.transform(find(text, pattern, text.rlike(SIGNS[name])), _voted(name, kind)) for name, kind, pattern in LOOSE])).cast(_CAND)
    return F.filter(found, _apart(base_spans(text) if base is None else base))


@dataclass
class Model:
    """Log-odds of the span classifier, and the labelers' estimated reliabilities."""

    prior: float = -99.0
    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, tuple[float, float]] = field(default_factory=dict)

    def accepts(self, c: Column) -> Column:
        """Whether the classifier accepts the candidate struct ``c``."""
        score = F.lit(self.prior)
        for i, name in enumerate(LABELERS):
            v = F.get(c["v"], F.lit(i))
            for value in (0, 1, ABSTAIN):
                w = self.weights.get(f"{name}={value}", 0.0)
                if w:
                    score = score + F.when(v == value, F.lit(w)).otherwise(F.lit(0.0))
        shapes = [(f, w) for f, w in sorted(self.weights.items()) if "/" in f]
        if shapes:
            known = F.create_map(*[F.lit(x) for fw in shapes for x in fw])
            score = score + F.aggregate(c["f"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(known, f), F.lit(0.0)))
        return score > math.log(ACCEPT / (1 - ACCEPT))


def em(counts: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], dict[str, tuple[float, float]]]:
    """Posterior of each vote pattern, and for each labeler P(votes yes | true) and P(votes yes | false) of its votes.

    Each labeler has a distribution over {no, yes, abstain} given the truth; counts are smoothed by one.
    """
    def start(p):
        votes = [x for x in p if x != ABSTAIN]
        return 0.5 if not votes else 0.1 + 0.8 * sum(votes) / len(votes)

    post = {p: start(p) for p in counts}
    table: list = []
    for _ in range(rounds):
        total = sum(counts.values())
        share = (sum(n * post[p] for p, n in counts.items()) + 1) / (total + 2)
        table = []
        for i in range(len(LABELERS)):
            sums = [[1.0] * 3, [1.0] * 3]
            for p, n in counts.items():
                sums[1][p[i]] += n * post[p]
                sums[0][p[i]] += n * (1 - post[p])
            table.append([[x / sum(row) for x in row] for row in sums])
        for p in counts:
            odds = math.log(share / (1 - share)) + sum(math.log(table[i][1][v] / table[i][0][v]) for i, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
    return post, {name: (table[i][1][1], table[i][0][1]) for i, name in enumerate(LABELERS)} if table else {}


def train(found: DataFrame, column: str) -> Model:
    """The classifier from all candidates of the array column ``column``."""
    each = found.select(F.explode(column).alias("c")).select(F.col("c.v").alias("v"), F.col("c.f").alias("f"))
    tally = each.groupBy("v", "f").agg(F.count("*").alias("n"))  # bounded by votes and shapes
    rows = [(tuple(r["v"]), tuple(r["f"]), r["n"]) for r in tally.collect()]
    if not rows:
        return Model()
    counts: dict[tuple[int, ...], int] = {}
    for v, _, n in rows:
        counts[v] = counts.get(v, 0) + n
    post, reliability = em(counts)
    yes, no, features = 1.0, 1.0, {}
    for v, f, n in rows:
        p = post[v]
        yes, no = yes + n * p, no + n * (1 - p)
        for x in (*(f"{name}={value}" for name, value in zip(LABELERS, v)), *f):
            a, b = features.get(x, (0.0, 0.0))
            features[x] = (a + n * p, b + n * (1 - p))
    weights = {x: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for x, (a, b) in features.items()}
    return Model(math.log(yes / no), weights, reliability)


def all_spans(base: Column, cands: Column, model: Model) -> Column:
    """Base spans and the accepted candidates, by start and kind."""
    accepted = F.filter(cands, model.accepts)
    inside = lambda c, b: (b["s"] <= c["s"]) & (c["e"] <= b["e"]) & ((b["s"] < c["s"]) | (c["e"] < b["e"]))
    added = let(accepted, lambda a: F.filter(a, lambda c: ~F.exists(a, lambda b: inside(c, b))))
    return F.array_distinct(F.sort_array(F.concat(base, F.transform(added, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))))))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def extracted(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, base spans and candidates of each row, written once."""
    text = F.col("t")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], plain(text_of(text_col)).alias("t"))
    rows = rows.withColumn("base", base_spans(text))
    return materialise(rows.select(*[F.col(f"`{c}`") for c in keep], "base", candidates(text, F.col("base")).alias("cands")), "pii-spans")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets."""
    # spans that begin inside an earlier one add nothing but its end
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,s:int,k:int>>").alias("out"))
    cuts = F.aggregate(
        spans, zero,
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["at"].alias("a"), x["s"].alias("s"), x["k"].alias("k"))))).alias("out"),
        ),
    )
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    own = let(cuts, lambda c: F.concat(
        F.array_join(F.transform(c["out"], lambda x: F.concat(F.substring(text, x["a"] + 1, x["s"] - x["a"]), F.get(names, x["k"]))), ""),
        F.substring(text, c["at"] + 1, F.length(text)),
    ))
    return F.when(F.size(spans) > 0, own).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; the classifier is trained on ``docs``."""
    found = extracted(docs, text_col)
    model = train(found, "cands")
    discard(found)
    own = free_name(docs, "spans")
    spans = let(plain(text_of(text_col)), lambda t: let(base_spans(t), lambda b: all_spans(b, candidates(t, b), model)))
    changed = F.when(F.col(f"`{text_col}`").isNotNull(), masked(text_of(text_col), F.col(own)))
    return docs.withColumn(own, spans).withColumn(text_col, changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "documents"), keep=("doc_id", "text"))
    model = train(found, "cands")
    base = F.col("base")

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda x: x["k"] == k)).cast("long").alias(f"n_{BASE_KINDS[k]}")

    spans = all_spans(base, F.col("cands"), model)
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_added"), masked(text_of(), spans).alias("text"))
