"""Mix sources to target weights: repetition rates per source, floor(rate) copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import join_counted, materialize
from .text import n_words

#: Rows that are equal in all columns are numbered in chunks of so many.
CHUNK = 4096


def source_targets(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, documents, target.

    Sources in order of code points, null last, take the weights in turn. They share the sum of all sizes by weight;
    no target exceeds `most` times the source's size, and what is cut off is shared again by weight among the others.
    The result follows in closed form: in order of limit per weight, a source is at its limit if the equal level of
    what is left after those before it would exceed that limit. An empty table gives no rows; a source of size 0 gets 0.
    """
    by_source = docs.select("source", n_words("text").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("long")).withColumn("most", F.col("source_size") * most)
    # most/weight as an exact order: compare most * (product of the other weights)
    product = 1
    for w in weights:
        product *= w
    level = Window.orderBy(F.expr(f"most * ({product} div weight)"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = weighed.withColumns(
        {
            "spent": F.coalesce(F.sum("most").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "total": F.sum("source_size").over(every),
        }
    ).withColumn("full", (F.col("total") - F.col("spent")) * F.col("weight") >= F.col("most") * F.col("left_weight"))
    # The full ones come first in the order; the rest share what those leave.
    rest = placed.withColumns(
        {
            "rest_total": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0)),
            "rest_weight": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(every), F.lit(0)),
        }
    )
    share = F.try_divide((F.col("rest_total") * F.col("weight")).cast("double"), F.col("rest_weight").cast("double"))
    return rest.select("source", "source_size", "documents", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a column `among`: 0, or for rows that are equal in all columns a number of their own, from 0 on.

    Rows that repeat are few as a rule; they become one row with a count, which is then written out again in chunks, so
    no task holds all rows of a large group, and no order among equal rows matters.
    """
    names = docs.columns
    key = [F.col(c).isNull() if c == "text" else F.col(c) for c in names] + [F.xxhash64("text")]
    hashed = docs.withColumn("_row", F.xxhash64(*[x for c in names for x in (F.col(c).isNull(), F.col(c))]))
    counts = materialize(hashed.groupBy("_row").agg(F.count("*").alias("_n")).filter("_n > 1"), "mix-repeated")
    if counts.isEmpty():
        return docs.withColumn("among", F.lit(0).cast("long"))
    single = hashed.join(counts.select("_row"), "_row", "left_anti").drop("_row").withColumn("among", F.lit(0).cast("long"))
    # a shared hash alone doesn't make rows equal
    groups = hashed.join(counts.select("_row"), "_row", "left_semi").groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)])
    groups = groups.agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in names])
    chunked = groups.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_n - 1) div {CHUNK})")))
    spread = chunked.repartition("_chunk", *[f"_k{i}" for i in range(len(key))])
    again = spread.withColumn("among", F.explode(F.expr(f"sequence(_chunk * {CHUNK}, least(_n, (_chunk + 1) * {CHUNK}) - 1)")))
    return single.unionByName(again.select(*names, "among"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """Each document with the number of copies that the mix takes: doc_id, text, lang, source, size, source_size, target, copies, taken.

    A document of a source with rate = target / source_size is taken floor(rate) times, and once more if a number in
    [0, 1) drawn from the md5 of seed, doc_id, source, the text's md5 and its number among equal rows is below the rest:
    rows without an id and rows that share one draw for themselves, so every source comes near its target. Null texts
    have size 0; nulls draw as "null"; other columns of docs don't take part.
    """
    targets = materialize(source_targets(docs, weights, most), "mix-targets")
    kept = [c for c in ("doc_id", "text", "lang", "source") if c in docs.columns]
    sized = numbered(docs.select(*kept)).withColumn("size", n_words("text"))
    # a source may be null: its key is a pair that isn't
    own = sized.withColumns({"_none": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    key = targets.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", "documents")
    joined = join_counted(own, key, ["_none", "_source"], docs.count(), "documents").drop("_none", "_source")
    rate = F.when(F.col("source_size") > 0, F.least(F.try_divide("target", "source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    of = [F.coalesce(x.cast("string"), F.lit("null")) for x in (F.col("doc_id"), F.col("source"), F.md5("text"), F.col("among"))]
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *of)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    copies = (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*kept, "size", "source_size", "target", "copies", "taken")
