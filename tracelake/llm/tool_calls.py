"""Tool-call linking for chat data, in DataFrame operations alone.

Calls and results meet by a shuffled hash join on their identifier. Calls are ordered by level: a call that waits for
no known call has level 0, others one more than the highest of the calls that they wait for. Calls with one dependency
are brought to the call that their chain begins with by pointer doubling, so a chain of n calls takes log2(n) joins;
a dependency that another dependency of the same call waits for itself is left out first; calls that still have several
are peeled level by level, so the rounds are as many as such calls lie one behind the other.
Arguments are checked against schemas that are compiled to column expressions over the parsed value, nested objects and
arrays included, and each linked call is written as canonical JSON: keys in order, no white space.

Defined results: a null identifier links with nothing; of several results with one identifier the first by
position counts; repeated calls each get a row, and wait for what any of them waits for; dependencies that are null or
unknown do not count; calls on a cycle, and those that wait for one, have a null level; arguments that are null or not
JSON are invalid and written as null; other columns are left out, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import discard, let, materialise, table, work_path

_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def _obeys(value: Column, rule: dict) -> Column:
    """Whether the variant ``value`` obeys ``rule``: type, minLength, maxLength, pattern, minimum, maximum, enum; for arrays
    items, minItems, maxItems; for objects properties and additional (whether others are allowed)."""
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    items = F.try_variant_get(value, "$", "array<variant>")
    tests = {
        "type": lambda name: kind.rlike(_TYPES[name]), "minLength": lambda n: F.length(text) >= n, "maxLength": lambda n: F.length(text) <= n, "pattern": lambda p: text.rlike(p),
        "minimum": lambda n: number >= n, "maximum": lambda n: number <= n, "enum": lambda v: text.isin(*[x if isinstance(x, str) else json.dumps(x) for x in v]),
        "minItems": lambda n: F.size(items) >= n, "maxItems": lambda n: F.size(items) <= n, "items": lambda own: F.forall(items, lambda x: _obeys(x, own)),
        "properties": lambda own: _object(value, own, rule.get("additional", False)),
    }
    ok = F.lit(True)
    for key, test in tests.items():
        if key in rule:
            ok = ok & F.coalesce(test(rule[key]), F.lit(False))
    return ok


def _object(value: Column, rules: dict[str, dict], additional: bool = False) -> Column:
    """Whether the variant ``value`` is an object whose properties obey ``rules``. Names are keys, not paths: dots and quotes are signs like others."""
    def judged(members: Column) -> Column:
        ok = members.isNotNull()
        if not additional:
            known = F.array(*[F.lit(p) for p in sorted(rules)]).cast("array<string>")
            ok = ok & (F.size(F.array_except(F.map_keys(members), known)) == 0)
        for name, rule in sorted(rules.items()):
            at = F.try_element_at(members, F.lit(name))
            ok = ok & F.when(at.isNull(), F.lit(not rule.get("required", False))).otherwise(_obeys(at, rule))
        return ok

    return F.coalesce(let(F.try_variant_get(value, "$", "map<string,variant>"), judged), F.lit(False))


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether JSON ``arguments`` obey the schema of the tool ``name``: {tool: {property: rule}}; other properties are errors."""
    value = F.try_parse_json(arguments)
    out = F.when(value.isNull(), F.lit(False))
    for tool, rules in sorted(schemas.items()):
        out = out.when(name == tool, _object(value, rules))
    return out.otherwise(F.lit(False))


#: Dependencies of calls with more than these are not searched for needless ones; the levels are the same either way.
REDUCED = 16


def _needed(edges: DataFrame) -> DataFrame:
    """``edges`` (call_id, up) without those that cannot decide a level: c -> d where c -> e and e -> d.

    Only an e of a later name than d takes an edge away, so of calls on or behind a cycle the last dependency that is so
    as well stays. Each edge meets at most REDUCED others.
    """
    degree = edges.groupBy("call_id").agg(F.count("*").alias("n")).filter(F.col("n") <= REDUCED)
    several = edges.join(degree.filter("n > 1").select("call_id"), "call_id", "left_semi")
    beyond = edges.join(degree.select("call_id"), "call_id", "left_semi").select(F.col("call_id").alias("e"), F.col("up").alias("d"))
    late = lambda c: F.struct(F.length(F.col(c).cast("string")), F.col(c))
    needless = several.join(beyond, (F.col("up") == F.col("e")) & (late("e") > late("d"))).select("call_id", F.col("d").alias("up"))
    return edges.join(needless, ["call_id", "up"], "left_anti")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of the distinct ids of ``calls`` (call_id, waits_for: an id or an array of ids); null on and behind cycles."""
    spark = calls.sparkSession
    known = calls.filter("call_id is not null")
    ids = known.select("call_id").distinct()
    up = F.explode("waits_for") if isinstance(calls.schema["waits_for"].dataType, T.ArrayType) else F.col("waits_for")
    edges = known.select("call_id", up.alias("up")).filter("up is not null").join(ids.select(F.col("call_id").alias("up")), "up", "left_semi")
    given = materialise(edges.select("call_id", "up").distinct(), "call-edges")
    edges = materialise(_needed(given), "call-edges")
    discard(given)
    counted = edges.groupBy(F.col("call_id").alias("c")).agg(F.count("*").alias("n"), F.min("up").alias("first"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    # a call with none or several dependencies is a head; others point upwards until they point to one
    state = ids.join(counted, F.col("call_id") == F.col("c"), "left").select(
        "call_id", F.when(one, F.col("first")).otherwise(F.col("call_id")).alias("up"), one.cast("long").alias("steps"), (~one).alias("there"), F.col("n").isNull().alias("root"),
    )
    state = materialise(state, "call-levels")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        if state.filter("not there").isEmpty():
            break
        above = state.select(F.col("call_id").alias("p"), F.col("up").alias("above"), F.col("steps").alias("more"), F.col("there").alias("done"), F.col("root").alias("roots"))
        moved = state.filter("not there").join(above, F.col("up") == F.col("p"))
        moved = moved.select("call_id", F.col("above").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("done").alias("there"), F.col("roots").alias("root"))
        old, state = state, materialise(state.filter("there").unionByName(moved), "call-levels")
        discard(old)
    joins = state.filter("there and up = call_id and not root").select("call_id")
    chained = state.withColumn("level", F.when(F.col("there") & F.col("root"), F.col("steps")))
    if joins.isEmpty():
        discard(edges)
        return chained.select("call_id", "level")
    heads = state.select(F.col("call_id").alias("p"), F.when(~(F.col("there") & F.col("root")), F.col("up")).alias("head"), (F.col("steps") + 1).alias("steps"))
    # waiting: an edge whose head is null is settled, and steps is the level that it asks for
    waiting = materialise(edges.join(joins, "call_id", "left_semi").join(heads, F.col("up") == F.col("p")).select("call_id", "head", "steps"), "call-joins")
    discard(edges)
    path, rounds = work_path(spark, "call-settled"), 0
    while True:
        part = f"{path}/round={rounds}"
        waiting.groupBy("call_id").agg(F.max("steps").alias("level"), F.count("head").alias("left")).filter("left = 0").select("call_id", "level").write.parquet(part)
        settled = spark.read.schema(T.StructType([ids.schema["call_id"], T.StructField("level", T.LongType())])).parquet(part)
        if settled.isEmpty():
            break
        known_now = settled.select(F.col("call_id").alias("h"), "level")
        rest = waiting.join(settled.select("call_id"), "call_id", "left_anti").join(known_now, F.col("head") == F.col("h"), "left")
        settles = F.col("h").isNotNull()
        rest = rest.select("call_id", F.when(~settles, F.col("head")).alias("head"), F.when(settles, F.col("steps") + F.col("level")).otherwise(F.col("steps")).alias("steps"))
        old, waiting, rounds = waiting, materialise(rest, "call-joins"), rounds + 1
        discard(old)
    settled = spark.read.schema(settled.schema).parquet(path).select(F.col("call_id").alias("h"), F.col("level").alias("base"))
    found = chained.join(settled, F.col("up") == F.col("h"), "left")
    return found.select("call_id", F.coalesce("level", F.when(F.col("there"), F.col("steps") + F.col("base"))).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """call_id, position, level, linked, valid, canonical for each row of ``calls``.

    ``calls``: call_id, position, name, arguments (JSON text), waits_for (an id or an array of ids); ``results``: call_id, position, content.
    """
    first = results.filter("call_id is not null").groupBy(F.col("call_id").alias("r")).agg(F.min_by(F.struct(F.lit(True).alias("there"), "content"), F.struct("position", "content")).alias("x"))
    depth = levels(calls.select("call_id", "waits_for")).select(F.col("call_id").alias("c"), "level")
    own = calls.select("call_id", "position", "name", "arguments")
    joined = own.join(first.hint("shuffle_hash"), F.col("call_id") == F.col("r"), "left").join(depth, F.col("call_id") == F.col("c"), "left")
    linked = F.coalesce(F.col("x.there"), F.lit(False))
    parts = joined.select(
        "call_id", "position", "level", linked.alias("linked"), valid_arguments(F.col("name"), F.col("arguments"), schemas).alias("valid"),
        F.to_json(F.try_parse_json("arguments")).alias("a"), "name", F.col("x.content").alias("content"),
    )
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]"))
    bare = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    parts = parts.withColumns({"qi": quoted(F.col("call_id")), "qn": quoted(F.col("name")), "qr": quoted(F.col("content"))})
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce("a", F.lit("null")), F.lit(',"id":'), bare("qi"), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), bare("qn"), F.lit(',"result":'), bare("qr"), F.lit("}"),
    )
    return parts.select("call_id", "position", "level", "linked", "valid", text.alias("canonical"))


#: The query reads each user turn as a call of ``reply`` that waits for the user's last two turns, and the assistant's next turn as its result.
REPLY = {"reply": {"text": {"type": "string", "minLength": 1, "required": True}, "turn": {"type": "integer", "minimum": 0, "required": True}}}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    name = lambda shift: F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
    calls = turns.filter("role = 'user'").select(
        name(0).alias("call_id"), F.col("turn").alias("position"), F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn"), F.col("text"))).alias("arguments"), F.array(name(2), name(4)).alias("waits_for"),
    )
    results = turns.filter("role = 'assistant'").select(name(1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    found = link_calls(calls, results, REPLY)
    return found.select("call_id", F.col("position").alias("turn"), "level", "linked", "valid", F.octet_length("canonical").cast("long").alias("n_bytes"), F.sha2("canonical", 256).alias("canonical_sha256"))


OP2_SQL = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text, conv_id || '/' || turn AS call_id FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id || '/' || (turn - 1) AS call_id, arg_min(text, (turn, text)) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1),
nodes AS (SELECT DISTINCT conv_id, turn FROM calls),
reached AS (SELECT conv_id, turn, 0 AS level FROM nodes UNION SELECT n.conv_id, n.turn, r.level + 1 FROM reached r JOIN nodes n ON n.conv_id = r.conv_id AND (n.turn = r.turn + 2 OR n.turn = r.turn + 4)),
depth AS (SELECT conv_id, turn, max(level) AS level FROM reached GROUP BY 1, 2),
written AS (
  SELECT c.call_id, c.turn, d.level, r.call_id IS NOT NULL AS linked, length(c.text) >= 1 AS valid,
    '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' ELSE '"text":' || CAST(to_json(c.text) AS VARCHAR) || ',' END || '"turn":' || c.turn || '},"id":"' || c.call_id || '","level":' || d.level
      || ',"name":"reply","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS canonical
  FROM calls c JOIN depth d USING (conv_id, turn) LEFT JOIN results r ON r.call_id = c.call_id)
SELECT call_id, turn, CAST(level AS BIGINT) AS level, linked, coalesce(valid, false) AS valid, CAST(strlen(canonical) AS BIGINT) AS n_bytes, sha256(canonical) AS canonical_sha256 FROM written
"""
