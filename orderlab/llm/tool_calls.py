"""Chat formatting: tool-call linking.

``link`` joins calls and results by (conv_id, call_id) with hash joins, orders the
calls topologically, validates their arguments against schemas and serialises each
as canonical JSON.

* Order: a call's level is 0 without dependencies, else one more than the highest
  level it depends on, found by shortening dependency chains (``levels``).  Sorting by (conv_id, level, turn, call_id) is a topological order.
  Calls on or behind a dependency cycle have level null and status ``cycle``.
* Validation: arguments must be a JSON object with every required parameter, no
  unknown parameter and the right types; ``errors`` lists what is wrong, sorted.
* Canonical JSON: keys sorted at every depth, no white space, null fields left out
  (arguments are parsed to a variant, whose objects are sorted by key).

DataFrame expressions only; every join is on (conv_id, call_id), so a conversation
with a third of all rows is spread over the tasks.  Edge cases: calls or results
with a null conversation or id are kept as ``unlinked``; of repeated call ids the
first by turn and arguments counts, of repeated results the first by turn and
content (their numbers are reported); a result without a call is
``orphan_result``, a call without a result ``unanswered``; a dependency on an
unknown call or on the call itself is ignored; empty tables give an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlab.session import cut_lineage

KEY = ["conv_id", "call_id"]
TYPES = {"string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN",
         "array": "^ARRAY", "object": "^OBJECT"}


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted problems of the arguments; ``schemas``: tool -> parameter -> (type, required)."""
    v = F.try_parse_json(arguments)
    kind = F.schema_of_variant(v)
    none = F.lit(None).cast("string")
    checks = [F.when(v.isNull(), "not_json"), F.when(v.isNotNull() & ~kind.startswith("OBJECT"), "not_object"),
              F.when(name.isNull() | ~name.isin(*schemas), "unknown_tool")]
    unknown = F.array().cast("array<string>")
    for tool, params in schemas.items():
        own = (name == tool) & kind.startswith("OBJECT")
        for p, (type_, required) in params.items():
            got = F.schema_of_variant(F.try_variant_get(v, f"$.{p}", "variant"))
            if required:
                checks.append(F.when(own & got.isNull(), f"missing:{p}"))
            checks.append(F.when(own & got.isNotNull() & ~got.rlike(TYPES[type_]), f"type:{p}"))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(p) for p in params]).cast("array<string>")),
                            lambda k: F.concat(F.lit("unknown:"), k))
        unknown = F.when(own, extra).otherwise(unknown)
    return F.array_sort(F.filter(F.concat(F.array(*[F.coalesce(c, none) for c in checks]), unknown),
                                 lambda x: x.isNotNull()))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls outside cycles.  ``edges``: (conv_id,
    call_id, dep_id).

    Every call has a lower bound ``low`` of its level and open edges (dep_id, w): its
    level is the largest of ``low`` and w + level(dep_id).  In a round an edge to a call
    without open edges turns into a bound, and an edge to a call with one open edge
    skips to that edge's end.  Chains halve in every round, so a chain of n calls takes
    about log2(n) rounds; only successive calls with several different open
    dependencies take one round each.  A path as long as the largest conversation has
    calls proves a cycle."""
    nodes = calls.select(*KEY).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("dep_id"))
    edges = cut_lineage(edges.select(*KEY, "dep_id").distinct().where("dep_id <> call_id")
                        .join(nodes, KEY, "left_semi").join(known, ["conv_id", "dep_id"], "left_semi")
                        .withColumn("w", F.lit(1).cast("long")))
    nodes = cut_lineage(nodes.withColumn("low", F.lit(0).cast("long")).withColumn("cycle", F.lit(False)))
    most = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    before, out = None, []
    while True:
        now = edges.agg(F.count("*"), F.sum("w")).first()
        if now[0] == 0 or now == before:
            break  # all done, or only calls on or behind cycles are left
        before = now
        # only calls at either end of an open edge take part in the round
        ends = edges.select(*KEY).union(edges.select("conv_id", "dep_id")).distinct()
        out.append(nodes.join(ends, KEY, "left_anti"))
        nodes = nodes.join(ends, KEY, "left_semi")
        open_ = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep_id").alias("next"), F.max("w").alias("step"))
        dep = (nodes.join(open_, KEY, "left").select(
            "conv_id", F.col("call_id").alias("dep_id"), F.col("low").alias("dep_low"), F.col("cycle").alias("dep_cycle"),
            F.coalesce("n", F.lit(0)).alias("n"), "next", "step"))
        end = F.expr("case when dep_cycle or n = 0 then null when n = 1 then next else dep_id end")
        moved = cut_lineage(edges.join(dep, ["conv_id", "dep_id"]).select(
            *KEY, end.alias("dep_id"), F.expr("case when n = 1 then w + step else w end").alias("w"),
            F.expr("case when n <= 1 then w + dep_low end").alias("gain"), "dep_cycle"))
        gained = moved.groupBy(*KEY).agg(
            F.max("gain").alias("gain"), F.bool_or(F.col("dep_cycle") | (F.col("w") >= most)).alias("found"))
        nodes = cut_lineage(nodes.join(gained, KEY, "left").select(
            *KEY, F.greatest("low", "gain").alias("low"), (F.col("cycle") | F.coalesce("found", F.lit(False))).alias("cycle")))
        edges = cut_lineage(moved.where("dep_id is not null").groupBy(*KEY, "dep_id").agg(F.max("w").alias("w"))
                            .join(nodes.where("cycle"), KEY, "left_anti"))
    out.append(nodes.join(edges, KEY, "left_anti"))
    return reduce(DataFrame.union, out).where("not cycle").select(*KEY, F.col("low").alias("level"))


def link(calls: DataFrame, results: DataFrame, edges: DataFrame,
         schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call, orphan result group and unlinked row: conv_id, call_id, turn,
    level, status, n_calls, n_results, errors, record (canonical JSON).

    calls: conv_id, call_id, turn, name, arguments; results: conv_id, call_id, turn,
    content."""
    usable = "conv_id is not null and call_id is not null"
    one_call = (calls.where(usable).groupBy(*KEY)
                .agg(F.min(F.struct("turn", "arguments", "name")).alias("call"), F.count("*").alias("n_calls")))
    one_result = (results.where(usable).groupBy(*KEY)
                  .agg(F.min(F.struct("turn", "content")).alias("result"), F.count("*").alias("n_results")))
    order = levels(one_call, edges)
    both = (one_call.join(order, KEY, "left").hint("shuffle_hash")
            .join(one_result.hint("shuffle_hash"), KEY, "full_outer"))
    unlinked = (calls.where(f"not ({usable})").select(*KEY, F.struct("turn", "arguments", "name").alias("call"))
                .unionByName(results.where(f"not ({usable})").select(*KEY, F.struct("turn", "content").alias("result")),
                             allowMissingColumns=True).withColumn("unlinked", F.lit(True)))
    rows = both.withColumn("unlinked", F.lit(False)).unionByName(unlinked, allowMissingColumns=True)
    status = (F.when(F.col("unlinked"), "unlinked").when(F.col("call").isNull(), "orphan_result")
              .when(F.col("level").isNull(), "cycle").when(F.col("result").isNull(), "unanswered").otherwise("linked"))
    out = rows.select(
        *KEY, F.coalesce("call.turn", "result.turn").alias("turn"), "level", status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.when(F.col("call").isNotNull(), errors(F.col("call.name"), F.col("call.arguments"), schemas)).alias("errs"),
        "call", "result")
    arguments = F.try_parse_json("call.arguments")
    record = F.to_json(F.struct(
        arguments.alias("arguments"), "call_id", "conv_id", F.col("errs").alias("errors"), "level",
        F.col("call.name").alias("name"), F.col("result.content").alias("result"), "status"))
    return out.select(*KEY, "turn", "level", "status", "n_calls", "n_results",
                      F.coalesce(F.array_join("errs", ","), F.lit("")).alias("errors"), record.alias("record"))


# --- calls and results that the registered query derives from ``conversations`` ---

# Each user turn is an ``ask`` call, each system turn a ``configure`` call; an assistant
# turn is the result of the turn before it; calls depend on those one or two turns before.
SCHEMAS = {
    "ask": {"question": ("string", True), "turn": ("integer", True), "style": ("string", False)},
    "configure": {"prompt": ("string", True)},
}


def _call_id(conv: Column, turn: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", conv.cast("string"), turn.cast("string"))), 1, 16)


def conversation_parts(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls, results, edges) of a conversations table."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    ask = F.to_json(F.struct(turn.alias("turn"), text.alias("question")))
    configure = F.to_json(F.struct(text.alias("prompt"), F.when(F.length(text) > 200, True).alias("long")))
    calls = turns.where("role in ('user', 'system')").select(
        "conv_id", _call_id(conv, turn).alias("call_id"), "turn",
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", ask).otherwise(configure).alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", _call_id(conv, turn - 1).alias("call_id"), "turn",
                                                       text.alias("content"))
    edges = turns.where("role in ('user', 'system')").select(
        "conv_id", _call_id(conv, turn).alias("call_id"),
        F.explode(F.array(_call_id(conv, turn - 1), _call_id(conv, turn - 2))).alias("dep_id"))
    return calls, results, edges


CONVERSATIONS_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, substr(md5(conv_id || ':' || turn), 1, 16) AS id FROM conversations),
call AS (
  SELECT conv_id, id AS call_id, turn, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name, text
  FROM t WHERE role IN ('user', 'system')),
res AS (SELECT conv_id, substr(md5(conv_id || ':' || (turn - 1)), 1, 16) AS call_id, turn, text AS content
        FROM t WHERE role = 'assistant'),
edge AS (SELECT c.conv_id, c.call_id, d.call_id AS dep_id FROM call c JOIN call d
         ON c.conv_id = d.conv_id AND d.turn IN (c.turn - 1, c.turn - 2)),
walk AS (SELECT conv_id, call_id, 0 AS level FROM call
         UNION SELECT e.conv_id, e.call_id, w.level + 1 FROM walk w JOIN edge e ON w.conv_id = e.conv_id AND w.call_id = e.dep_id),
lev AS (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL),
b AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
             coalesce(c.turn, r.turn) AS turn, l.level, c.name, c.text, r.content,
             CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
             c.name = 'configure' AND length(c.text) > 200 AS extra
      FROM call c LEFT JOIN lev l USING (conv_id, call_id) FULL OUTER JOIN res r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, CAST(turn AS BIGINT) AS turn, CAST(level AS BIGINT) AS level, status,
       CAST(CASE WHEN status = 'orphan_result' THEN 0 ELSE 1 END AS BIGINT) AS n_calls,
       CAST(CASE WHEN status = 'unanswered' THEN 0 ELSE 1 END AS BIGINT) AS n_results,
       CASE WHEN extra THEN 'unknown:long' ELSE '' END AS errors,
       '{' || CASE WHEN name = 'ask' THEN '"arguments":{"question":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},'
                   WHEN extra THEN '"arguments":{"long":true,"prompt":' || CAST(to_json(text) AS VARCHAR) || '},'
                   WHEN name = 'configure' THEN '"arguments":{"prompt":' || CAST(to_json(text) AS VARCHAR) || '},' ELSE '' END
       || '"call_id":"' || call_id || '","conv_id":' || conv_id
       || CASE WHEN status = 'orphan_result' THEN '' WHEN extra THEN ',"errors":["unknown:long"]' ELSE ',"errors":[]' END
       || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level || ',"name":"' || name || '"' END
       || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END
       || ',"status":"' || status || '"}' AS record
FROM b"""
