"""Mix sources to target weights: whole epochs first, then an Efraimidis-Spirakis selection.

Every document gets the key -ln(u) / w, with u a hash of its id and w its quality weight; small keys
come first, which is sampling without replacement in proportion to w. A source's target is its
share of all words, at most ``MAX_EPOCHS`` times its size, the excess being shared out again. The
target's whole multiples of the source are epochs that every document joins; the rest goes to the
documents that fit into it and whose running sum in key order stays within it. What is then left is
dealt in the same way among the remaining ones, ``PASSES`` times in all, and the shortest that is left
over joins if that brings the source nearer to its target.

The running sum is never formed in one task per source: rows are sorted by (source, key) over as
many ranges as the data needs, each range is summed on its own and raised by what lies before it.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlake.llm.common import prepare, stored

WORD = r"[^\x20\x09-\x0D]+"
#: The sources' weights by rank, repeating, and the most a document may be repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: A document without letters still has this weight.
FLOOR = 0.05
SEED = "mix-1"
#: Prefix sums over what fits into a source's rest.
PASSES = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """The share of letters among a text's characters, and a floor above zero."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    share = letters / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(share, F.lit(0.0)) + F.lit(FLOOR)


def exponential_key(identity: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u in (0, 1] from the first 52 bits of an MD5 of seed and identity."""
    name = F.concat(F.lit(seed + "|"), F.coalesce(identity.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 1) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) with the target of each source; one row a source.

    Sources in the order of target limit per weight fill up one after the other as the common
    level rises; the first that the level does not reach fixes the level for all behind it.
    """
    # windows over one row per source
    kind = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), kind + 1))
    ranked = ranked.withColumn("_limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    ) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    full = F.col("_limit") / F.col("_w") <= F.col("_level")
    return (
        ranked.withColumn("_level", level)
        .withColumn("_common", F.max(F.when(~full, F.col("_level"))).over(everything))
        .withColumn("target", F.when(full, F.col("_limit").cast("double"))
                    .otherwise(F.col("_w") * F.col("_common")))
        .select("source", "source_size", "target")
    )


def mix(docs: DataFrame, identity: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
        most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs`` (``identity``, text, source): its share in the mix.

    Returns ``identity``, size (words), source_size, target, copies and taken = copies * size. A
    NULL or empty text has size 0 and takes nothing; a NULL source is a source of its own and the
    last in order; repeated rows are documents of their own; rows equal in key fall into a fixed
    order by identity and size. Other columns are ignored. Reruns agree.
    """
    return _shares(docs, identity, weights, most, seed).select(
        identity, "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeated(docs: DataFrame, identity: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
             most: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, with all its columns.

    In key order a source's extra documents of the first pass come first among those that fit, so its
    epochs, its rest and the last of them say what becomes of nearly every document. That is one row a
    source: texts are read again, and their keys made again, rather than shuffled. The few of later
    passes are looked up. Rows equal in key, identity and size are taken alike.
    """
    shares = stored(_shares(docs, identity, weights, most, seed), "shares")
    place = F.struct("_key", F.col(identity).alias("_id"), "size")
    last = stored(
        shares.groupBy(F.col("source").alias("_source")).agg(
            F.max("_epochs").alias("_epochs"), F.max("_rest").alias("_rest"),
            F.max(F.when(F.col("_pass") == 1, place)).alias("_last"),
        ), "last",
    )
    later = stored(shares.where("_pass > 1").select(
        F.col("source").alias("_from"), place.alias("_place"), F.lit(True).alias("_later")
    ).distinct(), "later")
    own = F.struct(
        exponential_key(docs[identity], quality_weight(docs["text"]), seed).alias("_key"),
        docs[identity].alias("_id"), word_count(docs["text"]).alias("size"),
    )
    # made once, ahead of the joins that use it
    rows = docs.withColumn("__own", own)
    joined = rows.join(last, rows["source"].eqNullSafe(last["_source"]))
    # broadcast is bounded: later passes share what one crossing document a source left
    joined = joined.join(
        F.broadcast(later), rows["source"].eqNullSafe(later["_from"])
        & rows["__own"].eqNullSafe(later["_place"]), "left"
    )
    size = rows["__own"]["size"]
    early = (size > 0) & (size <= last["_rest"]) & last["_last"].isNotNull() & (rows["__own"] <= last["_last"])
    copies = last["_epochs"] + F.when(early | later["_later"].isNotNull(), 1).otherwise(0)
    columns = [rows[c] for c in docs.columns]
    return joined.select(
        *columns, F.explode(F.array_repeat(F.lit(True), copies.cast("int"))).alias("__copy")
    ).drop("__copy")


def _shares(docs: DataFrame, identity: str, weights: tuple[int, ...], most: int,
            seed: str) -> DataFrame:
    prepare(docs.sparkSession)
    weight = quality_weight(F.col("text"))
    rows = stored(docs.select(
        F.col(identity), "source", word_count(F.col("text")).alias("size"),
        exponential_key(F.col(identity), weight, seed).alias("_key"),
    ), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, most), "targets")
    epochs = F.when(
        F.col("source_size") > 0,
        F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size") + 1e-9)),
    ).otherwise(0).cast("long")
    plans = targets.withColumn("_epochs", epochs).withColumn(
        "_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_epochs") * F.col("source_size"))
    ).withColumnRenamed("source", "_source")

    ranged = stored(
        rows.orderBy(F.col("source").asc_nulls_last(), "_key", identity, "size")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranges",
    )
    open_rows, rests, picked = ranged, plans.select("_source", "_rest"), []
    for number in range(1, PASSES + 1):
        found = _fitting(open_rows, rests, number)
        picked.append(found.where("_pass is not null").select("_part", "_row", "_pass"))
        spent = found.where("_pass is not null").groupBy("source").agg(F.sum("size").alias("_spent"))
        rests = stored(
            rests.join(spent, rests["_source"].eqNullSafe(spent["source"]), "left").select(
                "_source", (F.col("_rest") - F.coalesce("_spent", F.lit(0))).alias("_rest")
            ), "rests",
        )
        open_rows = found.where("_pass is null").drop("_pass")
    extra = picked[0]
    for more in picked[1:]:
        extra = extra.unionByName(more)
    extra = stored(extra, "extra")
    # the shortest document left, if it brings its source nearer
    near = ranged.join(rests, ranged["source"].eqNullSafe(rests["_source"])).where(
        "size > 0 and size < 2 * _rest"
    ).join(extra, ["_part", "_row"], "left_anti").groupBy("source").agg(
        F.min(F.struct("size", "_key", identity, "_part", "_row")).alias("_first")
    )
    extra = extra.unionByName(
        near.select("_first._part", "_first._row", F.lit(PASSES + 1).alias("_pass"))
    )
    return (
        ranged.join(plans, ranged["source"].eqNullSafe(plans["_source"]))
        .join(extra, ["_part", "_row"], "left")
        .withColumn("copies", F.col("_epochs") + F.when(F.col("_pass").isNotNull(), 1).otherwise(0))
        .select(identity, "source", "size", "source_size", "target", "copies", "_key", "_epochs",
                "_rest", "_pass")
    )


def _fitting(rows: DataFrame, rests: DataFrame, number: int) -> DataFrame:
    """Those of ``rows`` that fit into their source's rest; ``_pass`` is the number for those dealt.

    Each range is summed on its own and raised by what lies before it, one row a range and source.
    """
    fits = stored(
        rows.join(rests, rows["source"].eqNullSafe(rests["_source"]))
        .where("size > 0 and size <= _rest").drop("_source"), "fitting",
    )
    sums = fits.groupBy("source", "_part").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(sums.select(
        F.col("source").alias("_from"), F.col("_part").alias("_range"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
    ), "offsets")
    upto = Window.partitionBy("_part", "source").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    dealt = fits.withColumn("_upto", F.sum("size").over(upto)).join(
        offsets, (F.col("_part") == F.col("_range")) & F.col("source").eqNullSafe(F.col("_from"))
    )
    within = F.col("_offset") + F.col("_upto") <= F.col("_rest")
    return stored(
        dealt.withColumn("_pass", F.when(within, F.lit(number))).select(*rows.columns, "_pass"), "dealt"
    )


_PASSES_SQL = ", ".join(f"""w{n} AS (
  SELECT *, NOT taken AND size > 0 AND size <= rest AS fits,
    sum(CASE WHEN NOT taken AND size > 0 AND size <= rest THEN size ELSE 0 END) OVER (
      PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c{n - 1}
), c{n} AS (
  SELECT * EXCLUDE (fits, upto) REPLACE (taken OR (fits AND upto <= rest) AS taken, rest - coalesce(
    sum(CASE WHEN fits AND upto <= rest THEN size END) OVER (PARTITION BY source), 0) AS rest) FROM w{n}
)""" for n in range(1, PASSES + 1))

#: The same mix as DuckDB SQL over ``documents``.
MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    coalesce(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g'))
             / greatest(length(text), 1), 0.0::DOUBLE) + {FLOOR}::DOUBLE AS w,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS bits
  FROM documents
), k AS (
  SELECT *, -ln((bits + 1)::DOUBLE / 4503599627370496.0::DOUBLE) / w AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1)
    % {len(WEIGHTS)}] AS sw, source_size * {MAX_EPOCHS} AS lim FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0))::DOUBLE
    / (sum(sw) OVER () - coalesce(sum(sw) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY lim / sw, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
    CASE WHEN lim / sw <= level THEN lim::DOUBLE
      ELSE sw * max(CASE WHEN lim / sw > level THEN level END) OVER () END AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0
    THEN least({MAX_EPOCHS}, floor(target / source_size + 1e-9))::BIGINT ELSE 0 END AS epochs FROM t
), c0 AS (
  SELECT k.*, source_size, target, epochs, greatest(0, target - epochs * source_size) AS rest,
    false AS taken
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
), {_PASSES_SQL}, near AS (
  SELECT *, NOT taken AND size > 0 AND size < 2 * rest AS may FROM c{PASSES}
), last AS (
  SELECT *, taken OR (may AND row_number() OVER (
    PARTITION BY source, may ORDER BY size, key, doc_id) = 1) AS extra FROM near
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM last
"""
