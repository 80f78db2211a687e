"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word target (weights of its rank in code-point order, water-filled under a cap
of `most_copies` times its size).  With r = target / size, each document gets floor(r) certain
whole copies; what is left of the target is a sample of whole documents.  For it every document
draws u from a hash of its seed, id and text and is ranked by

    (u / (1 - u)) / (p / (1 - p)),

p being its inclusion probability: the source's fraction f = r - floor(r), its odds tempered by
length, sqrt(mean size / size) within [1/2, 2] (a common factor of all odds, as for probabilities
that sum to a given number, would change no rank).  The sample's size is fixed in words: the ranking
is cut where the words run out, and the gap that is left, less than one document, goes to the one
unsampled document whose size comes nearest, if that comes nearer to the target than none.

The cut is found without sorting a source: two histograms of the ranks (2 x 10 bits) name a bin of
about a millionth of the source, and only that bin's rows are ordered.

Edge cases: a null or wordless text has size 0 and takes 0 words; a null source is a source, ranked
last; rows that are equal in id and text share one rank, so all or none of them are sampled; an
empty table gives an empty one; columns are kept whatever their names (a row travels as one struct,
results are in one struct `_mix`); a very long text is counted like any other, in one pass.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

#: Bins of each of the two histograms, and the most sources that are broadcast.
BINS, MOST_BROADCAST = 1024, 10_000


def facts(docs: DataFrame, seed: int = 0, keep: Sequence[str] | None = None) -> DataFrame:
    """__row, a struct of the columns to keep (all by default), where no name can clash; the source,
    the size in words and the hash that ranks the document."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    return docs.select(
        row.alias("__row"), "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("__h"))


def targets(sizes: DataFrame, share: float, weights: Sequence[float], most_copies: float) -> DataFrame:
    """One row for each source: __source, __total, __target, base copies, f, words to sample, mean size.

    Water-filling: sources in order of the level at which they fill up (cap / weight); a source is
    full if the level that would be left for it and all later ones reaches its own.  The windows run
    over one row for each source."""
    by = sizes.groupBy(F.col("source").alias("__source")).agg(F.sum("__size").alias("__total"), F.sum((F.col("__size") > 0).cast("long")).alias("__n"))
    rank = Window.orderBy(F.col("__source").isNull(), F.col("__source"))
    fill = Window.orderBy("__level", F.col("__source").isNull(), F.col("__source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("__w", w).withColumn("__cap", F.col("__total") * F.lit(float(most_copies))).withColumn("__level", F.col("__cap") / F.col("__w"))
    by = by.withColumn("__left", F.lit(share) * F.sum("__total").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    by = by.withColumn("__lambda", F.col("__left") / F.sum("__w").over(after))
    # levels fall from the first source that is not full on, so that row's level holds for the rest
    by = by.withColumn("__open", F.min(F.when(F.col("__lambda") < F.col("__level"), F.struct("__level", "__lambda"))).over(everything))
    by = by.withColumn("__target", F.when(F.col("__open").isNull() | (F.col("__level") < F.col("__open.__level")), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__open.__lambda") * F.col("__w"))))
    r = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
    base = F.floor(r + F.lit(1e-9))
    return by.select("__source", "__total", "__target", base.alias("__base"), F.greatest(r - base, F.lit(0.0)).alias("__f"),
                     F.greatest(F.col("__target") - base * F.col("__total"), F.lit(0.0)).alias("__budget"), (F.col("__total") / F.greatest("__n", F.lit(1))).alias("__mean"))


def rank_key() -> Column:
    """The Pareto rank, carried from odds q to q / (1 + q), which lies within (0, 1)."""
    u = (F.shiftrightunsigned("__h", 11).cast("double") + 0.5) / float(1 << 53)
    temper = F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.sqrt(F.col("__mean") / F.greatest("__size", F.lit(1)))))
    f = F.least(F.greatest(F.col("__f"), F.lit(1e-9)), F.lit(1 - 1e-9))
    q = (u / (1 - u)) / (f / (1 - f) * temper)
    return q / (1 + q)


def _with(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("__source")))


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with the struct `_mix`: size, source_size, target, copies, taken (a column of that name is
    replaced).  Options as of planned."""
    return planned(facts(docs.drop("_mix"), options.get("seed", 0)), **options).select("__row.*", "_mix")


def planned(rows: DataFrame, *, share: float = 1.5, weights: Sequence[float] = (5, 2, 1), most_copies: float = 2, seed: int = 0, written: bool = False) -> DataFrame:
    """__row and `_mix` from facts of the same seed; written: they are a table, cheap to read again."""
    sizes = rows if written else materialise(rows.select("source", "__size", "__h"), "mix-sizes")
    per = materialise(targets(sizes, share, weights, most_copies), "mix-targets")
    few = per.count() <= MOST_BROADCAST
    ranked = _with(sizes.filter("__size > 0").select("source", "__size", "__h"), per.filter("__budget > 0"), few).withColumn("__z", rank_key())
    ranked = ranked.withColumn("__b1", F.floor(F.col("__z") * BINS)).withColumn("__b2", F.floor(F.col("__z") * BINS * BINS) - F.col("__b1") * BINS)

    def edge(rows: DataFrame, bin_: str, spent: Column) -> DataFrame:
        """For each source, the first bin that the budget doesn't cover, and the words before it."""
        w = Window.partitionBy("__source").orderBy(bin_)
        sums = rows.groupBy("__source", bin_).agg(F.sum("__size").alias("__s"), F.first("__budget").alias("__budget"), F.first(spent).alias("__spent"))
        sums = sums.withColumn("__cum", F.col("__spent") + F.sum("__s").over(w))
        return sums.filter("__cum > __budget").groupBy("__source").agg(F.min(bin_).alias("__e"), F.min(F.col("__cum") - F.col("__s")).alias("__spent"))

    def narrowed(rows: DataFrame, edges: DataFrame, bin_: str) -> DataFrame:
        edges = edges.withColumnRenamed("__source", "__es")
        return rows.join(F.broadcast(edges) if few else edges, F.col("__source").eqNullSafe(F.col("__es")) & (F.col(bin_) == F.col("__e"))).drop("__e", "__es")

    first = materialise(edge(ranked, "__b1", F.lit(0).cast("long")), "mix-edge")
    in_first = narrowed(ranked, first, "__b1")
    second = materialise(edge(in_first, "__b2", F.col("__spent")), "mix-edge")
    in_second = narrowed(in_first.drop("__spent"), second, "__b2")
    order = Window.partitionBy("__source").orderBy("__z", "__h")
    cum = F.col("__spent") + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # the key of the first row left out: all rows before it are sampled
    cut = in_second.withColumn("__cum", cum).filter("__cum > __budget").groupBy("__source").agg(
        F.min(F.struct("__z", "__h")).alias("__cut"), F.min(F.col("__cum") - F.col("__size")).alias("__got"))
    cut = materialise(cut.withColumnRenamed("__source", "__cs"), "mix-cut")
    over = ranked.join(F.broadcast(cut) if few else cut, F.col("__source").eqNullSafe(F.col("__cs")))
    off = F.abs(F.col("__budget") - F.col("__got") - F.col("__size"))
    fill = over.filter((F.struct("__z", "__h") >= F.col("__cut")) & (off < F.col("__budget") - F.col("__got"))).groupBy("__cs").agg(
        F.min(F.struct(off.alias("off"), F.col("__z"), F.col("__h"))).alias("__fill"))
    fill = cut.join(fill.withColumnRenamed("__cs", "__fs"), F.col("__cs").eqNullSafe(F.col("__fs")), "left").select("__cs", "__cut", "__fill")
    per = materialise(per.join(fill, F.col("__source").eqNullSafe(F.col("__cs")), "left").drop("__cs"), "mix-cuts")

    key = F.struct(F.col("__z"), F.col("__h"))
    taken = F.coalesce((F.col("__budget") > 0) & (F.col("__size") > 0) & (F.col("__cut").isNull() | (key < F.col("__cut")) | F.coalesce(key == F.struct(F.col("__fill.__z").alias("__z"), F.col("__fill.__h").alias("__h")), F.lit(False))), F.lit(False))
    out = _with(rows, per, few).withColumn("__z", rank_key()).withColumn("__copies", F.col("__base") + taken.cast("long"))
    made = F.struct(F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__size") * F.col("__copies")).alias("taken"))
    return out.select("__row", made.alias("_mix"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of docs."""
    rows = planned(facts(docs, options.get("seed", 0)), **options)
    copies = F.array_repeat(F.lit(0), F.col("_mix.copies").cast("int"))
    return rows.filter("_mix.copies > 0").select("__row", F.explode(copies)).select("__row.*")
