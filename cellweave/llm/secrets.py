"""Secret scans with multipart credential linking, in DataFrame functions only (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage

# The base patterns, in the order in which equal starts are listed
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"  # the same runs without the short ones
KINDS = ("assign", "access", "hex")

# Weak candidates: (kind, role, pattern). They count only near a part of another role.
WEAK = (
    ("user", "id", r"""(?<![A-Za-z0-9_])(?i:(?:user(?:name|_?id)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""),
    ("key", "secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=_-])"),
    ("url", "endpoint", r"""(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""),
    ("host", "endpoint", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9.])"),
)
# Assignments of fewer than 12 characters are weak as well: kind "short"
ROLE = {"assign": "secret", "hex": "secret", "access": "id"} | {k: r for k, r, _ in WEAK} | {"short": "secret"}
NAMES = KINDS + tuple(k for k, _, _ in WEAK) + ("short",)
SPANS = "array<struct<start:bigint,no:int,stop:bigint,ok:boolean>>"
BLOCK = 256


def _blocks(values: Column) -> Column:
    """An array in slices of ``BLOCK`` elements; an empty one is one empty slice."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def _running(values: Column, join=lambda s, v: s + v, first: int = 0) -> Column:
    """What ``join`` makes of all values before each one, from ``first`` on. In blocks, so that long arrays stay near linear."""
    zero = F.lit(first).cast("bigint")
    blocks = _blocks(values)
    fold = lambda x: F.aggregate(x, zero, join)
    start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("out"))
    inner = lambda block, before: F.aggregate(
        block, start, lambda s, v: F.struct(join(s["sum"], v).alias("sum"), F.array_append(s["out"], join(before, s["sum"])).alias("out"))
    )["out"]
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(blocks, inner(F.transform(blocks, fold), zero), inner))).otherwise(F.array().cast("array<bigint>"))


def _with_spans(df: DataFrame, text_col: str, name: str, pattern: str, no: int, least: int = 1, group: int = 0, rest: int | None = None) -> DataFrame:
    """Add ``name``: leftmost non-overlapping matches as (start, no, stop, ok) in code points, the group long enough.

    With ``rest`` the shorter matches are kept too, with that number and ok false.

    The texts between matches and the matches alternate, so their lengths give the positions.
    """
    text, hit, gap, own = F.coalesce(F.col(text_col), F.lit("")), f"{name}_h", f"{name}_g", f"{name}_o"
    size = F.transform(hit, lambda h: F.length(h).cast("bigint"))
    n = F.size(hit)
    out = df.withColumn(hit, F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(gap, F.when(n > 0, F.transform(F.slice(F.split(text, pattern, -1), 1, n), lambda g: F.length(g).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn(own, F.zip_with(gap, F.slice(F.concat(F.array(F.lit(0).cast("bigint")), size), 1, n), lambda g, s: g + s))
    out = out.withColumn(gap, F.zip_with(_running(F.col(own)), F.col(own), lambda before, o: before + o))
    long = F.transform(hit, lambda h: F.length(h) >= least) if not group else F.transform(
        F.when(n > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>")), lambda h: F.length(h) >= least)
    found = F.zip_with(F.arrays_zip(F.col(gap).alias("b"), size.alias("s")), long, lambda x, ok: F.struct(
        x["b"].alias("start"), (F.lit(no) if rest is None else F.when(ok, no).otherwise(rest)).alias("no"), (x["b"] + x["s"]).alias("stop"), ok.alias("ok")))
    return out.withColumn(name, (found if rest is not None else F.filter(found, lambda x: x["ok"])).cast(SPANS)).drop(hit, gap, own)


def _shown(spans: Column) -> Column:
    kinds = F.array(*[F.lit(n) for n in NAMES])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kinds[x["no"]], x["start"], x["stop"])))


def _apart(found: DataFrame) -> DataFrame:
    """Keep the ``_weak`` spans that overlap no ``_base`` span: one sweep over both by start, base spans first, and one back.

    A span overlaps an earlier base span if the furthest stop so far lies behind its start, and a later one if the next base
    start lies before its stop.
    """
    base = lambda x: x["no"] < len(KINDS)
    far = 1 << 62
    out = found.withColumn("_all", F.when((F.size("_weak") > 0) & (F.size("_base") > 0), F.array_sort(F.concat("_base", "_weak"))).otherwise(F.array().cast(SPANS)))
    out = out.withColumn("_stop", F.transform("_all", lambda x: F.when(base(x), x["stop"]).otherwise(F.lit(0).cast("bigint"))))
    out = out.withColumn("_next", F.reverse(F.transform("_all", lambda x: F.when(base(x), x["start"]).otherwise(F.lit(far)))))
    out = out.withColumn("_stop", _running(F.col("_stop"), lambda s, v: F.greatest(s, v)))
    out = out.withColumn("_next", F.reverse(_running(F.col("_next"), lambda s, v: F.least(s, v), far)))
    free = F.filter(F.arrays_zip(F.col("_all").alias("x"), F.col("_stop").alias("stop"), F.col("_next").alias("next")),
                    lambda z: ~base(z["x"]) & (z["stop"] <= z["x"]["start"]) & (z["next"] >= z["x"]["stop"]))
    kept = F.when(F.size("_all") > 0, F.transform(free, lambda z: z["x"])).otherwise(F.col("_weak"))
    return out.withColumn("_weak", kept).drop("_all", "_stop", "_next")


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``_base``, the matches of the three base patterns, by start, then in the listed order, and ``_weak``.

    Weak candidates that overlap a base span are part of it and left out.
    """
    out = _with_spans(docs, text_col, "_base0", ASSIGN, 0, 12, 2, NAMES.index("short"))
    for no, pattern in ((1, LONG_ACCESS), (2, LONG_HEX)):
        out = _with_spans(out, text_col, f"_base{no}", pattern, no)
    for i, (_, _, pattern) in enumerate(WEAK):
        out = _with_spans(out, text_col, f"_weak{i}", pattern, len(KINDS) + i)
    out = out.withColumn("_base", F.array_sort(F.concat(F.filter("_base0", lambda x: x["ok"]), "_base1", "_base2")))
    weak = F.concat(*[f"_weak{i}" for i in range(len(WEAK))], F.filter("_base0", lambda x: ~x["ok"]))
    return _apart(out.withColumn("_weak", weak)).drop("_base0", "_base1", "_base2", *[f"_weak{i}" for i in range(len(WEAK))])


def linked_spans(found: DataFrame, reach: int = 300) -> DataFrame:
    """(_digest, _linked, _paired) of (_digest, _base, _weak): the weak candidates that a part of another role supports.

    Weak candidates (user names, mixed keys, short assignments, addresses) are reported only if a part of another role
    (identifier, secret, endpoint) starts within ``reach`` code points of them: ``_linked`` if one of these is a base
    span, ``_paired`` if all are weak themselves. Weak parts that overlap do not support each other, but an address and
    the short assignment in it do. The link is an interval join: candidates are laid into the scopes of ``reach`` code
    points round their start, parts into their own scope, and the two meet per (text, scope) in a left semi join.
    Spans depend on the text alone, so each distinct text is linked once.
    """
    parts = cut_lineage(found.dropDuplicates(["_digest"]).filter("size(_weak) > 0").select("_digest", "_base", "_weak"))
    roles = F.array(*[F.lit(ROLE[n]) for n in NAMES])
    scope = F.floor(F.col("x.start") / reach)
    loose = parts.select("_digest", F.explode("_weak").alias("x")).select("_digest", "x", F.explode(F.array(scope - 1, scope, scope + 1)).alias("scope"))

    def supported(kind: str, name: str) -> DataFrame:
        y = parts.select("_digest", F.explode(kind).alias("x")).select("_digest", scope.alias("scope"), F.col("x").alias("y"))
        a, b = loose["x"], y["y"]
        nested = F.array_sort(F.array(a["no"], b["no"])) == F.array(F.lit(NAMES.index("url")), F.lit(NAMES.index("short")))
        meets = (loose["_digest"] == y["_digest"]) & (loose["scope"] == y["scope"]) & (F.abs(a["start"] - b["start"]) <= reach) & (roles[a["no"]] != roles[b["no"]])
        meets &= (a["stop"] <= b["start"]) | (b["stop"] <= a["start"]) | nested
        return loose.join(y, meets, "left_semi").groupBy("_digest").agg(F.collect_set("x").alias(name))

    none = F.array().cast(SPANS)
    both = supported("_base", "_linked").join(supported("_weak", "_paired"), "_digest", "full")
    return both.select("_digest", F.coalesce("_linked", none).alias("_linked"), F.array_except(F.coalesce("_paired", none), F.coalesce("_linked", none)).alias("_paired"))


def _found(docs: DataFrame, text_col: str, *kept: str) -> DataFrame:
    """Written table of ``kept``, ``_base``, ``_weak`` and, where there is a span, the digest of the text."""
    found = scanned(docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_t")), "_t")
    some = F.size("_base") + F.size("_weak") > 0
    return cut_lineage(found.select(*kept, "_base", "_weak", F.when(some, F.sha2(F.col("_t").cast("binary"), 256)).alias("_digest")))


def _all_spans(*names: str, base: bool = True) -> Column:
    return F.array_sort(F.concat(*["_base"][:base], *[F.coalesce(n, F.array().cast(SPANS)) for n in names]))


def secret_report(docs: DataFrame, reach: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:stop``, joined) and weak_spans.

    ``spans`` holds base spans, what they support, and the weak parts that support each other; these last are in
    ``weak_spans`` as well. Null and empty texts have no spans and the digest of the empty string. Repeated rows and null ids stay rows of their
    own; other columns are not read. The texts are scanned once; only the spans of texts that have some go on.
    """
    based = _found(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")), "_x", "_id")
    found = based.filter("_digest IS NOT NULL")
    some = found.join(linked_spans(found, reach), "_digest", "left").select("_id", "_base", _all_spans("_linked", "_paired").alias("_spans"), _all_spans("_paired", base=False).alias("_pairs"))
    none = based.filter("_digest IS NULL").select("_id", "_base", F.col("_base").alias("_spans"), F.col("_base").alias("_pairs"))
    of_kind = lambda no: F.size(F.filter("_base", lambda x: x["no"] == no)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return some.union(none).select(F.col("_id").alias(id_col), *counts, F.sha2(_shown(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _shown(F.col("_spans")).alias("spans"), _shown(F.col("_pairs")).alias("weak_spans"))


def _masked(df: DataFrame, text_col: str, mask: str) -> DataFrame:
    """``text_col`` with the ``_spans`` masked. Each block of spans cuts its stretch of the text once, so work stays near linear.

    A span that starts behind all stops before it opens a mask; what lies between that furthest stop and its start stays.
    """
    text, n = F.col(text_col), F.col("_spans")
    part = lambda t, lo, hi: F.substring(t, (lo + 1).cast("int"), (hi - lo).cast("int"))
    out = df.withColumn("_at", F.transform(n, lambda x: x["stop"]))
    out = out.withColumn("_at", _running(F.col("_at"), lambda s, v: F.greatest(s, v)))
    gaps = F.filter(F.zip_with(n, F.col("_at"), lambda x, at: F.struct(at.alias("lo"), x["start"].alias("hi"))), lambda g: g["hi"] >= g["lo"])
    out = out.withColumn("_at", gaps)
    stretches = F.transform(_blocks(F.col("_at")), lambda b: F.struct(
        b.alias("gaps"), b[0]["lo"].alias("lo"), part(text, b[0]["lo"], F.element_at(b, -1)["hi"]).alias("t")))
    out = out.withColumn("_at", stretches)
    pieces = F.transform("_at", lambda s: F.array_join(F.transform(s["gaps"], lambda g: F.concat(part(s["t"], g["lo"] - s["lo"], g["hi"] - s["lo"]), F.lit(mask))), ""))
    end = F.aggregate(n, F.lit(0).cast("bigint"), lambda s, x: F.greatest(s, x["stop"]))
    whole = F.concat(F.array_join(pieces, ""), part(text, end, F.length(text)))
    return out.withColumn(text_col, F.when(n.isNotNull(), whole).otherwise(text))


def redact(docs: DataFrame, reach: int = 300, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; overlapping spans are replaced once, other texts stay."""
    text = F.col(text_col)
    found = _found(docs, text_col).filter("_digest IS NOT NULL").dropDuplicates(["_digest"])
    spans = cut_lineage(found.join(linked_spans(found, reach), "_digest", "left").select("_digest", _all_spans("_linked", "_paired").alias("_spans")).filter("size(_spans) > 0"))
    marked = docs.withColumn("_digest", F.sha2(text.cast("binary"), 256)).join(spans, "_digest", "left")
    return _masked(marked, text_col, mask).select(*docs.columns)
