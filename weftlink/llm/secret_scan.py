"""Secret scans by multipart credential linking; DataFrame functions only.

Parts of credentials are found by patterns, leftmost and non-overlapping within a kind:

* base kinds `assign`, `access`, `hex`, strong enough to be reported on their own;
* weak kinds `identifier` (user or key ids), `endpoint` (addresses of services) and `secret`
  (long mixed runs of letters and digits), reported only if linked.

A weak part that overlaps a base part, or a weak part of a kind listed before its own, is dropped.
The rest are linked by an interval join: a part's scope is its interval widened by `reach` code
points to both sides, and a complementary part is one whose interval meets that scope.  A secret
needs an identifier or an endpoint in its scope, an identifier or an endpoint needs a secret
(`assign` and `hex` count as secrets, `access` as an identifier).

The join emits no pairs: parts of a text are ordered by their start, and a part has a partner iff
the furthest end before it or the nearest start after it lies in its scope.  Offsets come from the
pieces between the matches, summed up by windows, so the work is linear in the number of parts,
and a text's own parts are the largest group.  Texts whose cheap tests show no part pass through
without any shuffle.

Edge cases: a null text is empty and has no spans; null or repeated ids don't matter (rows are told
apart by position); columns are carried whatever their names, but for `_spans`, which scan_secrets
replaces (redacted keeps it); all patterns run in constant stack, and offsets and redaction in time
linear in a text's length, so very long texts are texts like others; spans that start together are
ordered by kind; an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENTIFIER = r"""(?<![A-Za-z0-9_])(?:(?i:user(?:name)?|login|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}|(?:AKIA|ASIA|AROA)[A-Z0-9]{6,})"""
ENDPOINT = r"""(?<![A-Za-z0-9_])(?:[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"""
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"

#: Kinds in the order in which ties at one start are listed, and of precedence.
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "secret")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENTIFIER, ENDPOINT, SECRET), strict=True))
BASE = 3
SPANS = "array<struct<start:long,kind:int,end:long,before:long>>"
#: Code points of the pieces into which a text is cut for redaction.
_CUT = 512


def _suspect() -> Column:
    """Cheap tests; where they fail no base part and no weak secret exists, so nothing is reported."""
    low = F.lower("__t")
    words = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return words | F.col("__t").contains("AKIA") | F.col("__t").rlike(HEX) | F.col("__t").rlike(SECRET)


def _found(kind: int) -> Column:
    """array<struct<kind, gap, len, ok>>: the matches of a kind, in order; gap is what stands since the last."""
    p = PATTERNS[KINDS[kind]]

    def part(gap: Column, m: Column) -> Column:
        ok = {
            0: F.length(F.regexp_extract(m, p, 2)) >= 8,
            1: F.length(m) >= 16,
            5: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"),
        }.get(kind, F.lit(True))
        return F.when(m.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), ok.alias("ok")))

    return F.filter(F.zip_with(F.split("__t", p, -1), F.regexp_extract_all("__t", F.lit(p), F.lit(0)), part), lambda x: x.isNotNull())


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """docs with `_spans`: array<struct<start, kind, end, before>> in code points, end exclusive, by start,
    then kind; before is where all spans listed earlier have ended (0 for the first)."""
    docs = docs.drop("_spans")
    return _scanned(docs, reach).select("__row.*", "_spans")


def _scanned(docs: DataFrame, reach: int) -> DataFrame:
    """__row, a struct of all columns of docs, and _spans."""
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(carried.alias("__row"), F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    clean = rows.filter(~_suspect()).select("__row", F.array().cast(SPANS).alias("_spans"))

    rows = rows.filter(_suspect()).select("__row", F.monotonically_increasing_id().alias("__id"), F.concat(*map(_found, range(len(KINDS)))).alias("__parts"))
    rows = rows.select("__id", "__row", F.posexplode_outer("__parts").alias("__k", "__p"))
    # the row itself rides on its first part alone
    rows = rows.select("__id", F.when(F.coalesce(F.col("__k"), F.lit(0)) == 0, F.col("__row")).alias("__row"), "__k", "__p.*").repartition("__id")
    so_far = Window.partitionBy("__id", "kind").orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("ok", F.coalesce("ok", F.lit(False)))

    ok, kind = F.col("ok"), F.col("kind")
    by = Window.partitionBy("__id")
    # running frames in either order: one that ends with the group would take quadratic time
    before = by.orderBy("start", "kind", "__k").rowsBetween(Window.unboundedPreceding, -1)
    after = by.orderBy(F.desc("start"), F.desc("kind"), F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)

    def left(which: Column) -> Column:
        return F.max(F.when(which, F.col("end"))).over(before)

    def right(which: Column) -> Column:
        return F.min(F.when(which, F.col("start"))).over(after)

    def meets(x: str, margin: int) -> Column:
        """Whether a part comes within margin; 1 - margin is the least overlap."""
        return F.coalesce(F.col(f"__l{x}") >= F.col("start") - margin, F.lit(False)) | F.coalesce(F.col(f"__r{x}") <= F.col("end") + margin, F.lit(False))

    stronger = {str(weak): ok & (kind < weak) for weak in (3, 4, 5)}
    rows = rows.withColumns({f"__l{x}": left(which) for x, which in stronger.items()}).withColumns({f"__r{x}": right(which) for x, which in stronger.items()})
    hit = F.when(kind == 3, meets("3", -1)).when(kind == 4, meets("4", -1)).when(kind == 5, meets("5", -1)).otherwise(False)
    rows = rows.withColumn("ok", ok & ~hit)
    partner = {"s": ok & kind.isin(0, 2, 5), "i": ok & kind.isin(1, 3, 4)}
    rows = rows.withColumns({f"__r{x}": right(which) for x, which in partner.items()}).withColumns({f"__l{x}": left(which) for x, which in partner.items()})
    rows = rows.withColumns({f"__{x}": meets(x, reach) for x in partner})
    told = ok & ((kind < BASE) | F.when(kind == 5, F.col("__i")).otherwise(F.col("__s")))
    rows = rows.withColumn("__told", told).withColumn("before", F.coalesce(F.max(F.when(F.col("__told"), F.col("end"))).over(before), F.lit(0)))
    found = rows.groupBy("__id").agg(
        F.first("__row", ignorenulls=True).alias("__row"),
        F.sort_array(F.collect_list(F.when(F.col("__told"), F.struct("start", "kind", "end", "before")))).cast(SPANS).alias("_spans"))
    return clean.unionByName(found.select("__row", "_spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """docs with every reported span's text replaced by mark; overlapping spans become one."""
    rows = _scanned(docs, reach)
    text = F.col("__row.text")
    # a span that starts before all earlier ones have ended belongs to the mark before it
    heads = F.filter("_spans", lambda s: s["start"] >= s["before"])
    last = F.array_max(F.transform("_spans", lambda s: s["end"]))
    gaps = F.concat(F.transform(heads, lambda s: F.struct(s["before"].alias("a"), s["start"].alias("b"))), F.array(F.struct(last.alias("a"), F.length(text).cast("long").alias("b"))))
    # substrings count from the start, so they are taken from short pieces; the array of pieces is bound to
    # a variable of an outer lambda, as a column would be inlined and computed anew for each gap
    pieces = F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)))

    def kept(gap: Column, cut: Column) -> Column:
        a, b = gap["a"], gap["b"]
        first = F.floor(a / _CUT)
        whole = F.array_join(F.slice(cut, (first + 1).cast("int"), (F.floor((b - 1) / _CUT) - first + 1).cast("int")), "")
        return F.when(b > a, F.substring(whole, (a - first * _CUT + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def joined(cut: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda gap: kept(gap, cut)), mark)

    clean = F.when(F.size("_spans") > 0, F.transform(pieces, joined)[0]).otherwise(text)
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def spans_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of op5."""
    rows = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"] < BASE)

    def count(k: int) -> Column:  # a lambda of two arguments would get a span's place, too
        return F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = [count(k) for k in range(BASE)]
    return rows.select("doc_id", *n, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))
