"""Mix sources to target weights by hash-random keys, prefix sums and exact cuts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bin of the key space is meant to hold; of each source one bin is sorted in one task.
BIN_ROWS = 50_000


def word_count(text: Column | str) -> Column:
    """Words between ASCII white space; null counts 0."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Targets per source from rows (no_source, name, source_size).

    Sources in code-point order, null last, take ``weights`` in turn.  Targets share the total size by
    weight; a source stops at ``epochs`` times its size and the excess is shared again among the others.
    Sorted by the ratio of that limit to the weight, the sources that stop are those before one cut, which one
    pass of running sums finds.  One row per source, so the windows below see few rows.
    """
    by_name = Window.orderBy("no_source", "name")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    list_of = F.array(*[F.lit(int(w)) for w in weights])
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(list_of, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    stops = (
        F.col("cap") * F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
        <= F.col("weight") * (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    )
    shared = (
        ranked.withColumn("stops", stops)
        .withColumn("stopped", F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("sharing", F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0.0)).over(everything))
    )
    target = F.when(F.col("stops"), F.col("cap")).otherwise((F.col("total") - F.col("stopped")) * F.col("weight") / F.col("sharing"))
    budget = F.least(F.floor(target + 0.5).cast("long"), F.col("cap").cast("long"))
    return (
        shared.select("no_source", "name", "source_size", target.alias("target"), budget.alias("budget"))
        .withColumn("full", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("source_size"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: str = "mix",
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """How much of each row the mix takes: (id, source, size, source_size, target, epochs_full, taken).

    Each row gets the hash-random key md5(seed:id).  The keys are uniform, so the range sort within a source needs no
    sampling: the leading hex digits cut every source into bins of about ``bin_rows`` rows.  Word counts are summed per bin
    before the shuffle and added up over the bins of a source; a source takes every row ``full`` times and, in key order, once
    more up to its exact budget, so one bin of each source holds its cut.  Only those bins are sorted: the rows are
    compared with their source's cut where they lie.  The row at the cut is taken in part.

    Null ids and repeated ids are rows like others: rows with one key go by size, and in the sorted bins they are counted
    per size first, so a third of all rows under one id is no large group.  Rows equal in key and size are alike; if the cut falls
    among them, it takes as many as it needs in the order they were staged in.  A null source is a source of its own, last
    in order; null and empty texts have size 0 and take 0; an empty table gives an empty result; other columns
    are not read.  The narrow rows are staged once, so texts are read a single time.
    """
    size = word_count("text") if size is None else size
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).isNull().cast("int").alias("no_source"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), size.alias("size"), key.alias("key"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "mix-rows",
    )
    digits = max(0, math.ceil(math.log(max(1.0, rows.count() / bin_rows), 16)))
    rows = rows.withColumn("bin", F.substring("key", 1, digits))
    source = ["no_source", "name"]
    bins = rows.groupBy(*source, "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(bins.groupBy(*source).agg(F.sum("bin_size").alias("source_size")), weights, epochs)
    cuts = staged(_cuts(rows, bins, targets), "mix-cuts")

    placed = rows.join(cuts, source)
    same = (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    before = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("size") < F.col("cut_size")))
    apart = placed.where(~F.coalesce(same, F.lit(False))).withColumn("extra", F.when(before, F.col("size")).otherwise(F.lit(0)))
    # Rows alike at the cut are numbered by the part of the staged table that they lie in.
    alike = placed.where(same).withColumn("part", F.shiftright("at", 33))
    order = Window.partitionBy(*source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = alike.groupBy(*source, "part").agg(F.count(F.lit(1)).alias("n")).select(*source, "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"))
    number = F.col("earlier") + F.row_number().over(Window.partitionBy(*source, "part").orderBy("at")) - 1
    left = F.col("rest") - F.col("cut_start") - number * F.col("size")
    numbered = alike.join(parts, [*source, "part"]).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return apart.unionByName(numbered.select(*apart.columns)).select(
        F.col("id").alias(id_col), F.when(F.col("no_source") == 0, F.col("name")).alias(source_col), "size", "source_size", "target",
        F.col("full").alias("epochs_full"), (F.col("full") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def _cuts(rows: DataFrame, bins: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with the key and size at which each source's last epoch ends, and the words before them; null for sources without words."""
    source = ["no_source", "name"]
    start = F.sum("bin_size").over(Window.partitionBy(*source).orderBy("bin")) - F.col("bin_size")
    bins = bins.withColumn("bin_start", start).join(targets.select(*source, "rest"), source)
    bins = bins.where((F.col("bin_start") <= F.col("rest")) & (F.col("rest") < F.col("bin_start") + F.col("bin_size"))).drop("bin_size")
    groups = rows.join(bins, [*source, "bin"]).groupBy(*source, "bin_start", "rest", "key", "size").agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    inside = F.sum("words").over(Window.partitionBy(*source).orderBy("key", "size"))
    groups = groups.withColumn("cut_start", F.col("bin_start") + inside - F.col("words"))
    groups = groups.where((F.col("cut_start") <= F.col("rest")) & (F.col("rest") < F.col("cut_start") + F.col("words")))
    return targets.join(groups.select(*source, F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), "cut_start"), source, "left")


ORACLE = r"""
WITH r AS (
  SELECT doc_id AS id, (source IS NULL)::INT AS no_source, coalesce(source, '') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT no_source, name, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY no_source, name) AS rank FROM r GROUP BY 1, 2),
w AS (SELECT *, ([5, 2, 1])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE AS total FROM s),
c AS (SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
             <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS stops FROM w),
d AS (SELECT *, sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS stopped, sum(CASE WHEN stops THEN 0 ELSE weight END) OVER () AS sharing FROM c),
t AS (SELECT *, CASE WHEN stops THEN cap ELSE (total - stopped) * weight / sharing END AS target FROM d),
b AS (SELECT *, least(floor(target + 0.5), cap)::BIGINT AS budget FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM b),
p AS (SELECT r.id, r.name, r.no_source, r.size, e.source_size, e.target, e.epochs, e.budget - e.epochs * e.source_size AS rest,
             sum(r.size) OVER (PARTITION BY r.no_source, r.name ORDER BY r.key, r.id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS start
      FROM r JOIN e USING (no_source, name))
SELECT id AS doc_id, CASE WHEN no_source = 0 THEN name END AS source, size, source_size, target, epochs::BIGINT AS epochs_full,
       (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM p
"""
