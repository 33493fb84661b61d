"""Document fingerprints by winnowing, in DataFrame functions only (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BITS = 24
LOW = (1 << POSITION_BITS) - 1
HIGH = ~LOW
WHITE = " \t\n\x0b\x0c\r"


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _shifted(df: DataFrame, name: str, by: int, f) -> Column:
    """``f(x[i], x[i + by])`` for all i that have both."""
    c = F.col(name)
    return F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - by, F.lit(0))), _shift(c, by), f)


def winnowed(df: DataFrame, text_col: str, name: str, k: int = 5, window: int = 4) -> DataFrame:
    """Add ``name``: the winnowed hashes of a text with their positions, one BIGINT each, in text order.

    Words (lower case, between ASCII white space) are hashed, ``k`` neighbours are combined to a k-gram hash, and each
    window of ``window`` k-grams keeps its smallest hash, of equal ones the rightmost. So any run of k + window - 1
    equal words in two texts shares a kept hash. The low 24 bits hold 2^24 - 1 - position (modulo 2^24 in longer
    texts), which makes the rightmost of equal hashes the smallest number. A text with fewer than k words is one
    k-gram; a text without words keeps nothing. Sliding values double their reach in each step, so an array is passed
    over log(k) + log(window) times. k must be 2^j or 2^j + 1, window 2^j.
    """
    h, g = f"_{name}_h", f"_{name}_g"
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(WHITE))
    parts = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(trimmed), r"[\x20\x09-\x0D]+"))
    out = df.withColumn(h, F.transform(parts, lambda w: F.xxhash64(w)))
    pow2 = 1 << (k.bit_length() - 1)
    out, reach = out.withColumn(g, F.col(h)), 1
    while reach < pow2:
        out = out.withColumn(g, _shifted(out, g, reach, lambda a, b: F.xxhash64(a, b)))
        reach *= 2
    if k == pow2 + 1:
        out = out.withColumn(g, F.zip_with(F.slice(F.col(g), 1, F.greatest(F.size(g) - 1, F.lit(0))), _shift(F.col(h), pow2), lambda a, b: F.xxhash64(a, b)))
    elif k != pow2:
        raise ValueError("k must be 2^j or 2^j + 1")
    whole = F.when((F.size(h) > 0) & (F.size(h) < k), F.array(F.xxhash64(h))).otherwise(F.col(g))
    out = out.withColumn(g, F.transform(whole, lambda x, i: x.bitwiseAND(F.lit(HIGH)).bitwiseOR(F.lit(LOW) - i.cast("bigint").bitwiseAND(F.lit(LOW)))))
    out = out.withColumn(f"_{name}_n", F.greatest(F.size(g) - window + 1, F.least(F.size(g), F.lit(1))))
    step = 1
    while step < window:
        # the shorter side ends in nulls, which least() passes over: windows at the end are cut off below
        out = out.withColumn(g, F.zip_with(F.col(g), _shift(F.col(g), step), lambda a, b: F.least(a, b)))
        step *= 2
    return out.withColumn(name, F.array_distinct(F.slice(F.col(g), 1, F.col(f"_{name}_n")))).drop(h, g, f"_{name}_n")


def hashes(name: str) -> Column:
    return F.array_distinct(F.transform(F.col(name), lambda x: x.bitwiseAND(F.lit(HIGH))))


def positions(name: str) -> Column:
    """Index of the first word of every kept k-gram."""
    return F.transform(F.col(name), lambda x: F.lit(LOW) - x.bitwiseAND(F.lit(LOW)))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    same = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - same
    return F.when(every == 0, 1.0).otherwise(same / every)


def digest(name: str) -> Column:
    """128 bits over the kept hashes and positions, as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(name)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), F.col(name))), 16, "0")))


def with_next(docs: DataFrame, carry, n_buckets: int) -> DataFrame:
    """Rows (id, text) with what ``carry`` adds, and ``next_`` of each added column and the text: of the next id.

    Ids are cut into buckets at approximate quantiles, one shuffle brings a bucket together, and ``lead`` looks at the
    next row. The first rows of a bucket also go to the bucket before, as a mark at its end, and the first rows of
    all to the last bucket. Equal ids follow by text, null ids come first. Only bucket limits come to the driver.
    """
    probs = [i / n_buckets for i in range(1, n_buckets)]
    limits = sorted(set(docs.agg(F.percentile_approx("id", probs, 100 * n_buckets)).first()[0] or []))
    if limits:
        bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in limits]), lambda x: x <= F.col("id"))), F.lit(0))
        bucket = F.when(F.col("id").isNull(), 0).otherwise(bucket)
    else:
        bucket = F.lit(0)
    placed = docs.withColumn("bucket", bucket.cast("int"))
    firsts = sorted(placed.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("set"), F.col("id"))).alias("m")).select("bucket", "m.id").collect())
    if not firsts:
        firsts = [(0, None)]
    before = dict(zip([b for b, _ in firsts], [firsts[-1][0], *[b for b, _ in firsts[:-1]]]))
    top = max(before) + 1
    first_id = F.array(*[F.lit(dict(firsts).get(b)).cast(docs.schema["id"].dataType) for b in range(top)])
    ahead = F.array(*[F.lit(before.get(b)).cast("int") for b in range(top)])
    own = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("mark")))
    both = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("mark")), F.struct(ahead[F.col("bucket")].alias("b"), F.lit(1).alias("mark")))
    spread = placed.withColumn("to", F.explode(F.when(F.col("id").eqNullSafe(first_id[F.col("bucket")]), both).otherwise(own)))
    dealt = spread.select("id", "text", F.col("to.b").alias("bucket"), F.col("to.mark").alias("mark")).repartition(n_buckets, "bucket")
    ready = carry(dealt)
    order = Window.partitionBy("bucket").orderBy("mark", F.col("id").asc_nulls_first(), "text")
    added = [c for c in ready.columns if c not in ("id", "bucket", "mark")]
    return ready.select("id", "mark", *added, *[F.lead(c).over(order).alias(f"next_{c}") for c in added]).filter("mark = 0")


def edit_report(docs: DataFrame, k: int = 5, window: int = 4, id_col: str = "doc_id", text_col: str = "text", n_buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by id (after the last: the first; of a single document: itself). ``near_edited`` and ``near_next`` are
    Jaccard similarities of the kept hashes; ``positions`` lists the first words of the kept k-grams in text order. Null texts are empty, and two texts without words are alike (1).
    Repeated ids follow each other by text, null ids come first. Other columns are not read.
    """
    n_buckets = n_buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(plain, lambda df: winnowed(df, "text", "kept", k, window), n_buckets)
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next_text", "text"), F.lit(1), cut))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = winnowed(rows, "edited", "kept_edited", k, window).withColumn("next_kept", F.coalesce("next_kept", "kept"))
    rows = rows.withColumn("a", hashes("kept")).withColumn("b", hashes("kept_edited")).withColumn("c", hashes("next_kept"))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest("kept").alias("fingerprint"),
        digest("kept_edited").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), likeness("a", "c").alias("near_next"),
        F.concat_ws(",", positions("kept").cast("array<string>")).alias("positions"),
    )
