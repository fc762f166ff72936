"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens are added up by source, language and topic. Raking scales these cells in turn so
that each margin's shares meet their targets, with no cell above 1 / keep times its own
tokens; `keep` times the factor is then the probability at which each document of the
cell is kept, by a hash of its id. Expected tokens of every margin are `keep` times its
target, wherever the bound allows the target.

All steps are DataFrame functions. Documents are read, aggregated with partial sums, and
joined with the raked cells. Up to `TASK_CELLS` cells lie in one partition, where raking adds
up margins by windows, without a shuffle or a join (the driver keeps a thread and a plan for
each of those), and are broadcast to the documents; of more cells, margins are added up with
partial sums and joined with the cells, by the same steps.

A topic column is used if there is one; else the topic is what a whole text's characters
say: ``tabular`` (a hundredth or more are | or tabs), ``numeric`` (a twentieth or more are
digits), ``marked`` (a twentieth or more are symbols), else ``prose``. Null sources,
languages and topics form a value of their own; null and empty texts have no tokens and
are kept at the rate `keep`; texts count whole, however long; a null id draws like the text
'null', rows of equal id draw alike; an empty table gives no rows; further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: A cell has some hundred bytes; so many are a few MB.
TASK_CELLS = 50_000
#: Powers that shares are raised to for targets: below 1, large shares give way to small ones.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SYMBOLS = "!#$%&*+/<=>@[]^_`{}~"


def topic_of(text: Column) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return (
        F.when(F.length(t) == 0, "prose").when(count("|\t") * 100 >= F.length(t), "tabular").when(count("0123456789") * 20 >= F.length(t), "numeric")
        .when(count(SYMBOLS) * 20 >= F.length(t), "marked").otherwise("prose")
    )


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) for each id: 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """df with __mix_source, __mix_lang, __mix_topic, __mix_tokens and __mix_draw."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    topic = F.col("topic").cast("string") if "topic" in df.columns else topic_of(F.col(text_col))
    named = {"__mix_source": F.col("source").cast("string"), "__mix_lang": F.col("lang").cast("string"), "__mix_topic": topic}
    return df.withColumns({k: F.coalesce(v, F.lit(NONE)) for k, v in named.items()} | {"__mix_tokens": words, "__mix_draw": draw(F.col(id_col), seed)})


def rake(cells: DataFrame, powers: dict[str, float], bound: float, rounds: int, settled: float = 1e-13, together: bool = False) -> DataFrame:
    """source, lang, topic, tokens -> the same and factor: raked tokens over tokens.

    Rounds end early once none moves a cell by more than the share `settled` of itself. together: the cells are few enough
    for one partition."""
    # a checkpoint forgets that it has one partition, so each of them is told anew
    kept = lambda df: saved(df).coalesce(1) if together else saved(df)
    cells = cells.coalesce(1) if together else cells
    whole = cells.agg(F.sum("tokens")).scalar()
    for m in MARGINS:
        # a margin's target: its tempered share over the sum of all of its values' shares
        own = cells.groupBy(m).agg(F.pow(F.sum("tokens") / whole, F.lit(powers[m])).alias("p"))
        cells = cells.join(own.select(m, (F.col("p") / own.agg(F.sum("p")).scalar() * whole).alias(f"t_{m}")), m)
    cells = kept(cells.withColumn("x", F.col("tokens").cast("double")))
    for _ in range(rounds):
        cells = cells.withColumn("before", F.col("x"))
        for m in MARGINS:
            if together:
                cells = cells.withColumn("sum", F.sum("x").over(Window.partitionBy(m)))
            else:  # partial sums and a join: a window has all of a value's cells in one task
                cells = cells.join(cells.groupBy(m).agg(F.sum("x").alias("sum")), m)
            cells = cells.withColumn("x", F.least(F.col("x") * F.col(f"t_{m}") / F.col("sum"), F.col("tokens") * F.lit(bound))).drop("sum")
        cells = kept(cells)  # a plan of all rounds would be too deep
        if not cells.where(F.abs(F.col("x") - F.col("before")) > F.col("before") * settled).limit(1).count():
            break
        cells = cells.drop("before")
    return cells.select(*MARGINS, "tokens", (F.col("x") / F.col("tokens")).alias("factor"))


def with_probability(rows: DataFrame, keep: float = 0.5, powers: dict[str, float] = POWERS, rounds: int = 12, task_cells: int = TASK_CELLS) -> DataFrame:
    """Rows that have features(), with __mix_factor and __mix_probability."""
    named = [F.col(f"__mix_{m}").alias(m) for m in MARGINS]
    cells = rows.groupBy(*named).agg(F.sum("__mix_tokens").alias("tokens")).where("tokens > 0")
    cells = saved(cells)
    n = cells.count()
    raked = saved(rake(cells, powers, 1 / keep, rounds, together=n <= task_cells))
    factors = raked.select(*(F.col(m).alias(f"__mix_{m}") for m in MARGINS), F.col("factor").alias("__mix_factor"))
    out = rows.join(F.broadcast(factors) if n <= task_cells else factors, [f"__mix_{m}" for m in MARGINS], "left")
    factor = F.when(F.col("__mix_tokens") > 0, F.col("__mix_factor")).otherwise(F.lit(1.0))
    return out.withColumn("__mix_factor", factor).withColumn("__mix_probability", F.least(F.lit(1.0), F.col("__mix_factor") * F.lit(keep)))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept of every row. Texts are read once."""
    slim = features(df, id_col, text_col, seed).select(F.col(id_col).cast("long").alias("doc_id"), *(f"__mix_{m}" for m in MARGINS), "__mix_tokens", "__mix_draw")
    rows = with_probability(saved(slim), **options)
    names = [F.col(f"__mix_{m}").alias(m) for m in MARGINS]
    return rows.select("doc_id", *names, F.col("__mix_tokens").alias("n_tokens"), F.round("__mix_factor", 6).alias("weight"), F.round("__mix_probability", 6).alias("probability"), (F.col("__mix_draw") < F.col("__mix_probability")).alias("kept"))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, **options) -> DataFrame:
    """The rows of df that are drawn, with df's own columns. Texts are read twice rather than written once more."""
    return with_probability(features(df, id_col, text_col, seed), **options).where("__mix_draw < __mix_probability").select(*df.columns)


def oracle_sql(keep: float = 0.5, powers: dict[str, float] = POWERS, rounds: int = 12, seed: int = 1) -> str:
    """The same as plan() in DuckDB's SQL, by one common table expression a raking step."""
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS t,
          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE AS u FROM documents)""",
        f"""f AS (SELECT doc_id, source, lang, u, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
          CASE WHEN length(t) = 0 THEN 'prose' WHEN (length(t) - length(replace(replace(t, '|', ''), chr(9), ''))) * 100 >= length(t) THEN 'tabular'
               WHEN {count('0123456789')} * 20 >= length(t) THEN 'numeric' WHEN {count(SYMBOLS)} * 20 >= length(t) THEN 'marked' ELSE 'prose' END AS topic FROM d)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM f GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in MARGINS:
        parts.append(f"s_{m} AS (SELECT {m}, power(sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM c), {powers[m]}::DOUBLE) AS p FROM c GROUP BY {m})")
        parts.append(f"t_{m} AS (SELECT {m}, p / (SELECT sum(p) FROM s_{m}) * (SELECT sum(tokens) FROM c) AS target FROM s_{m})")
    parts.append("x0 AS (SELECT *, tokens::DOUBLE AS x FROM c)")
    for k in range(rounds):
        for i, m in enumerate(MARGINS):
            at = k * len(MARGINS) + i
            parts.append(f"x{at + 1} AS MATERIALIZED (SELECT * REPLACE (least(x * target / sum(x) OVER (PARTITION BY {m}), tokens * {1 / keep!r}::DOUBLE) AS x) FROM (SELECT x{at}.*, target FROM x{at} JOIN t_{m} USING ({m})))".replace(f"x{at}.*, target", f"x{at}.* EXCLUDE (x), x, target").replace("SELECT * REPLACE", "SELECT * EXCLUDE (target) REPLACE"))
    last = f"x{rounds * len(MARGINS)}"
    return f"""WITH {', '.join(parts)}
SELECT doc_id, f.source, f.lang, f.topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN x / tokens ELSE 1.0 END, 6) AS weight,
       round(least(1.0, CASE WHEN n_tokens > 0 THEN x / tokens ELSE 1.0 END * {keep}::DOUBLE), 6) AS probability,
       u < least(1.0, CASE WHEN n_tokens > 0 THEN x / tokens ELSE 1.0 END * {keep}::DOUBLE) AS kept
FROM f LEFT JOIN {last} AS r ON f.source = r.source AND f.lang = r.lang AND f.topic = r.topic"""
