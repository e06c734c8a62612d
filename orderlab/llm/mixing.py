"""Mixing sources to target weights by iterative proportional fitting.

1. Every document gets a token count and a topic; tokens are summed per cell
   (source, language, topic) with partial aggregation, so a source that holds a
   third of all rows costs no more shuffle than any other.
2. Targets: each margin's share of tokens, raised to ``power`` and normalised
   (flattening large sources), unless given.
3. Raking: cell weights are scaled to the source, language and topic margins in
   turn, ``sweeps`` times, on the small cell table.
4. Sampling: a cell's rate is its calibrated weight over its tokens, scaled so that
   the expected sample holds ``keep`` of all tokens.  A document is drawn
   floor(rate) times, plus once more if a hash of its id falls below the remaining
   fraction; rates above one repeat documents, so no margin is cut off.

Everything is DataFrame expressions.  Null source or language is a margin value of
its own (empty string); null or empty texts have no tokens, belong to topic
``empty`` and, like cells without tokens, have rate 0; repeated rows have the same
draw; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlab.session import cut_lineage

DIMS = ("source", "lang", "topic")
BLANKS = r"[\x20\x09-\x0D]+"
SWEEPS, POWER, KEEP, SEED = 10, 0.5, 0.5, 17


def token_count(text: Column) -> Column:
    """Words separated by ASCII white space."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """Topic by the first rule that fits: licence lines, contact data, tables, markup
    symbols, short or long prose."""
    return (F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
            .when(text.contains("License"), "licence").when(text.contains("@"), "contact")
            .when(text.contains("|"), "table").when(text.contains("###"), "markup")
            .when(F.length(text) < 1000, "short").otherwise("long"))


TOPIC_SQL = """CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN contains(text, 'License') THEN 'licence'
  WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '###') THEN 'markup'
  WHEN length(text) < 1000 THEN 'short' ELSE 'long' END"""


def draw(doc_id: Column) -> Column:
    """Number in [0, 1) from the id: 48 bits of an MD5 with the seed."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** 12))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): all that raking and sampling need."""
    text = F.col("text")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce("lang", F.lit("")).alias("lang"), topic(text).alias("topic"),
                       token_count(text).alias("tokens"))


def rake(cells: DataFrame, sweeps: int = SWEEPS, power: float = POWER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) plus ``weight``, raked to the targets.
    Each step is one window sum over a margin of the cell table, whose size is the
    number of different cells, not of documents; every sweep is
    one job whose result is checkpointed."""
    out = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMS:
        own = F.sum("weight").over(Window.partitionBy(d))
        out = out.withColumn(f"target_{d}", F.pow(own, F.lit(power)))
    # every margin's targets sum to 1: the weights of a margin value share its target
    for d in DIMS:
        share = F.col("weight") / F.sum("weight").over(Window.partitionBy(d))
        out = out.withColumn(f"part_{d}", share * F.col(f"target_{d}"))
    totals = out.agg(*[F.sum(f"part_{d}").alias(f"all_{d}") for d in DIMS])
    out = cut_lineage(out.crossJoin(F.broadcast(totals)).select(  # one row
        *DIMS, "tokens", "weight", *[(F.col(f"target_{d}") / F.col(f"all_{d}")).alias(f"target_{d}") for d in DIMS]))
    for _ in range(sweeps):
        for d in DIMS:
            now = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.col("weight") * F.col(f"target_{d}") / now)
        out = cut_lineage(out)  # a short plan is re-planned faster than one of all sweeps
    return out.select(*DIMS, "tokens", "weight")


def rates(docs: DataFrame, sweeps: int = SWEEPS, power: float = POWER, keep: float = KEEP) -> DataFrame:
    """(source, lang, topic, tokens, weight, rate) of every cell with tokens."""
    cells = measured(docs).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, sweeps, power)
    total = raked.agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    return raked.crossJoin(F.broadcast(total)).select(  # one row
        *DIMS, "tokens", (F.col("weight") / F.col("all_weight")).alias("weight"),
        (F.lit(keep) * F.col("all_tokens") * F.col("weight") / F.col("all_weight") / F.col("tokens")).alias("rate"))


def copies(rate: Column, doc_id: Column) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def sample(docs: DataFrame, sweeps: int = SWEEPS, power: float = POWER, keep: float = KEEP) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (of its tokens, whole corpus 1),
    rate and copies of every document; the text is not carried through a shuffle."""
    cell = rates(docs, sweeps, power, keep).withColumnRenamed("tokens", "cell_tokens")
    rate = F.coalesce("rate", F.lit(0.0))
    out = measured(docs).join(cell, list(DIMS), "left")
    return out.select(
        "doc_id", *DIMS, "tokens",
        F.coalesce(F.col("weight") * F.col("tokens") / F.col("cell_tokens"), F.lit(0.0)).alias("weight"),
        rate.alias("rate"), copies(rate, F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, sweeps: int = SWEEPS, power: float = POWER, keep: float = KEEP) -> DataFrame:
    """The drawn documents: the columns of ``docs`` plus mix_topic, mix_rate and
    mix_copies (times the document is to be used, at least 1)."""
    own = ["__source", "__lang", "mix_topic"]
    cell = rates(docs, sweeps, power, keep).select(
        *[F.col(d).alias(n) for d, n in zip(DIMS, own, strict=True)], F.col("rate").alias("mix_rate"))
    kept = [c for c in docs.columns if c not in ("mix_topic", "mix_rate", "mix_copies")]
    keyed = docs.select(*kept, F.coalesce("source", F.lit("")).alias(own[0]),
                        F.coalesce("lang", F.lit("")).alias(own[1]), topic(F.col("text")).alias(own[2]))
    return (keyed.join(cell, own).withColumn("mix_copies", copies(F.col("mix_rate"), F.col("doc_id")))
            .where("mix_copies > 0").select(*kept, "mix_topic", "mix_rate", "mix_copies"))


def sample_sql(sweeps: int = SWEEPS, power: float = POWER, keep: float = KEEP) -> str:
    """``sample`` as DuckDB SQL: one CTE per raking step."""
    parts = [f"""m AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {TOPIC_SQL} AS topic,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents)""",
             "c0 AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS t FROM m GROUP BY ALL HAVING sum(tokens) > 0)"]
    for d in DIMS:
        parts.append(f"p_{d} AS (SELECT {d}, pow(sum(t), {power}) AS p FROM c0 GROUP BY {d})")
        parts.append(f"t_{d} AS (SELECT {d}, p / (SELECT sum(p) FROM p_{d}) AS target FROM p_{d})")
    parts.append("w0 AS MATERIALIZED (SELECT *, t AS w FROM c0)")
    n = 0
    for _ in range(sweeps):
        for d in DIMS:
            parts.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, w * target / now AS w FROM w{n} "
                         f"JOIN (SELECT {d}, sum(w) AS now FROM w{n} GROUP BY {d}) USING ({d}) JOIN t_{d} USING ({d}))")
            n += 1
    parts.append(f"r AS (SELECT source, lang, topic, t, w / (SELECT sum(w) FROM w{n}) AS weight, {keep} * "
                 f"(SELECT sum(t) FROM w{n}) * w / (SELECT sum(w) FROM w{n}) / t AS rate FROM w{n})")
    u = (f"CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}'), 1, 12) AS BIGINT) AS DOUBLE)"
         f" / {float(16 ** 12)!r}")
    return f"""WITH {', '.join(parts)}
    SELECT doc_id, source, lang, topic, tokens, round(coalesce(weight * tokens / t, 0.0), 12) AS weight,
      round(coalesce(rate, 0.0), 6) AS rate, CAST(floor(coalesce(rate, 0.0)) + CASE WHEN {u} <
        coalesce(rate, 0.0) - floor(coalesce(rate, 0.0)) THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM m LEFT JOIN r USING (source, lang, topic)"""
