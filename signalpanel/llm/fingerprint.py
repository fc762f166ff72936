"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions alone.

A text's words (runs of anything but space, tab, newline, vertical tab, form feed and
return, lower-cased) give the set of its shingles of five words; a shorter text is one
shingle, a text without words none. The fingerprint holds the k smallest distinct
64-bit hashes of the set. Fingerprints merge: the k smallest of two fingerprints'
union are the fingerprint of the union of the sets. From them follow resemblance
(Jaccard), containment and the number of distinct shingles; all three are exact for
sets of at most k shingles.

Null texts are empty. Equal texts have equal fingerprints. Two empty fingerprints
resemble each other fully, an empty and another one not at all. Empty tables give no
rows; further columns are ignored, and own columns begin with __print_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
WORDS = 5
SPACE = r"[\x20\x09-\x0D]+"


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the column `out`: the fingerprint of the text column, ascending hashes (array of long)."""
    words = F.filter(F.split(F.lower(F.col(text)), SPACE), lambda w: w != "")
    df = df.withColumn("__print_h", F.transform(words, lambda w: F.xxhash64(w)))
    # the hash list is named more than once below, so that the optimizer keeps it as a column and computes it once
    n = F.size("__print_h")
    shingle = lambda i: F.xxhash64(*(F.get(F.col("__print_h"), i + j) for j in range(WORDS)))
    many = F.transform(F.sequence(F.lit(0), n - WORDS), shingle)
    hashes = F.when(n >= WORDS, many).when(n > 0, F.array(F.xxhash64("__print_h"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("__print_h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's fingerprint that both have."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b: resemblance x size of the union / size of a, 1 for an empty a."""
    inside = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), inside))


def merged_by(df: DataFrame, group: str, fingerprint: str, k: int = K, fan_in: int = 256) -> DataFrame:
    """group, fingerprint of all its rows. Rows merge in random parts of about fan_in first, so a hot group is no hot task."""
    fan_in = max(2, fan_in)
    parts = max(1, -(-df.count() // fan_in))
    step = lambda d, *keys: d.groupBy(*keys).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("f")))), 1, k).alias("f"))
    rows = df.select(F.col(group).alias("g"), F.col(fingerprint).alias("f"))
    salted = rows.withColumn("s", F.pmod(F.xxhash64("f", F.monotonically_increasing_id()), F.lit(parts)))
    while parts > 1:
        salted = step(salted, "g", "s")
        parts = -(-parts // fan_in)
        salted = salted.withColumn("s", F.pmod("s", F.lit(parts)))
    return step(salted, "g").select(F.col("g").alias(group), F.col("f").alias(fingerprint))


def hex_string(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _cuts(df: DataFrame, key: Column, parts: int) -> list[int]:
    """Values of the key that cut the rows into ranges of about equal size, ascending; the first is the smallest key."""
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.min(key).alias("least"), F.percentile_approx(key, shares or [0.5], 10_000).alias("cuts")).first()
    return [] if row.least is None else sorted({row.least, *row.cuts})


def with_next(df: DataFrame, key: str, carried: list[str], parts: int) -> DataFrame:
    """df with next_<column> of the row that follows by the key; the first follows the last.

    Rows are dealt by ranges of the key, cut at keys that occur, and the first row of each
    range goes to the range before it as well, so one shuffle is enough and no task holds
    more than a range. Nulls come first, ties are ordered by the carried columns."""
    order = F.coalesce(F.col(key), F.lit(-(2**63)))
    cuts = _cuts(df, order, parts)
    if not cuts:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    # which range: by every 64th cut first, then by the cuts after it
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts[::64])), lambda c: c <= F.col("__print_k"))) - 1
    fine = F.size(F.filter(F.slice(F.array(*map(F.lit, cuts)), F.col("__print_c") * 64 + 1, F.lit(64)), lambda c: c <= F.col("__print_k"))) - 1
    df = df.withColumn("__print_k", order).withColumn("__print_c", coarse).withColumn("__print_r", F.col("__print_c") * 64 + fine).drop("__print_c")
    before = F.when(F.col("__print_k") != F.element_at(F.array(*map(F.lit, cuts)), F.col("__print_r") + 1), None)
    before = before.when(F.col("__print_r") == 0, F.struct(F.lit(len(cuts) - 1).alias("r"), F.lit(2).alias("halo"))).otherwise(F.struct((F.col("__print_r") - 1).alias("r"), F.lit(1).alias("halo")))
    places = F.filter(F.array(F.struct(F.col("__print_r").alias("r"), F.lit(0).alias("halo")), before), lambda p: p.isNotNull())
    dealt = df.withColumn("__print_p", F.explode(places)).withColumn("__print_r", F.col("__print_p.r")).withColumn("__print_halo", F.col("__print_p.halo")).drop("__print_p")
    w = Window.partitionBy("__print_r").orderBy("__print_halo", "__print_k", *carried)
    out = dealt.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return out.where("__print_halo = 0").drop("__print_r", "__print_k", "__print_halo")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by the start of the next document's text."""
    parts = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # several ranges a task, so that tasks are even
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "own", k), "doc_id", ["text", "own"], parts)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "new", k)
    own, new = F.col("own"), F.col("new")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hex_string(own).alias("fingerprint"), hex_string(new).alias("edited_fingerprint"),
        resemblance(own, new, k).alias("near_edited"), resemblance(own, F.col("next_own"), k).alias("near_next"), containment(new, own, k).alias("edited_in_own"), distinct_shingles(own, k).alias("shingles"),
    )
