"""Mixing sources to target weights by weighted fair queueing.

The documents of a source are shuffled by the digest of their id. The virtual finish time of
a document is the cumulative size of its source up to and with it, over the source's weight;
a source may be gone through ``repeats`` times. The mix is the prefix of all (document, round)
entries in order of finish time whose sizes fit the budget. A source that is used up leaves
its share to the others by weight, so the virtual time at the cut also gives the targets.

No sum runs over one key in one task: cumulative sizes are sums within even buckets of the
shuffled order plus the sums of the buckets before, one row per bucket. The cut is found from
sums per bucket of virtual time, and entries are only sorted within the bucket it falls in.
Sources are a table of one row each (weights are a parameter per source), and only that
table and the bucket sums, at most ``BUCKETS`` rows each, pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import with_scalars
from .common import fresh, written

#: Rows wanted in a bucket, and the most buckets of a source or of the virtual time.
BUCKET_ROWS, BUCKETS = 1000, 100_000


def words(text: Column) -> Column:
    """Number of words, maximal runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, weight): the weights repeat over the sources by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("place", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return listed.select("source", "place", pick.alias("weight"))


def fill_targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """``sources`` (source, place, weight, source_size, rows) with budget, virtual time and target.

    The time solves sum(min(weight * time, repeats * source_size)) = share * sum(source_size).
    """
    every = Window.partitionBy()
    by_end = Window.orderBy("ends", "place")
    row = sources.withColumn("most", repeats * F.col("source_size")).withColumn(
        "ends", F.col("most") / F.col("weight")).withColumn(
        "budget", F.lit(float(share)) * F.sum("source_size").over(every))
    spent = F.sum("most").over(by_end.rowsBetween(Window.unboundedPreceding, -1))
    still = F.sum("weight").over(by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    row = row.withColumn("time_here", (F.col("budget") - F.coalesce(spent, F.lit(0))) / still)
    time = F.coalesce(F.max(F.when(F.col("time_here") <= F.col("ends"), F.col("time_here"))).over(every),
                      F.max("ends").over(every))
    row = row.withColumn("time", time)
    return row.withColumn("target", F.least(F.col("weight") * F.col("time"), F.col("most").cast("double"))).select(
        "source", "place", "weight", "source_size", "rows", "budget", "time", "target")


def _buckets(rows: Column) -> Column:
    return F.least(F.lit(BUCKETS), F.greatest(F.lit(1), F.ceil(rows / BUCKET_ROWS))).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2,
             doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rounds (times it is taken), taken,
    finish (virtual finish time of its first round), and the ``carry`` columns.

    Null texts and texts without words have size 0 and are never taken. Null sources are a
    source, last in order. Documents with the same id are ordered by size and text; equal
    rows are interchangeable. An empty table gives no rows.
    """
    inputs = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")).alias("draw"),
        F.xxhash64(text).alias("body"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    sized = written(inputs)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = written(sources)
    named = cycle_weights(sources.select("source"), weights).withColumnRenamed("source", "named")
    sources = written(fill_targets(
        sources.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named"), share, repeats))
    table = sources.withColumnRenamed("source", "of")
    rows = sized.join(table, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = rows.withColumn("bucket", F.floor(at * _buckets(F.col("rows"))))
    sums = rows.groupBy("place", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("place", "bucket").orderBy("draw", "size", "body").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    queued = rows.withColumn("own", F.sum("size").over(inside)).join(sums, ["place", "bucket"]).withColumn(
        "upto", F.col("ahead") + F.col("own")).drop("own", "ahead", "bucket", "draw", "body")
    return _cut(written(queued), sources, repeats, carry)


def _entry(k: int) -> Column:
    """Order of an entry in the mix: finish time, source, round, cumulative size."""
    upto = F.col("upto") + F.lit(k) * F.col("source_size")
    return F.struct((upto / F.col("weight")).alias("finish"), F.col("place").alias("place"), F.lit(k).alias("round"),
                    upto.alias("upto"))


def _slot(entry: Column, slots: Column) -> Column:
    """Bucket of virtual time; 0 where the whole time is 0."""
    return F.when(F.col("time") > 0, F.floor(entry["finish"] / F.col("time") * slots)).otherwise(F.lit(0)).cast("long")


def _cut(queued: DataFrame, sources: DataFrame, repeats: int, carry: tuple[str, ...]) -> DataFrame:
    slots = sources.agg(_buckets(repeats * F.coalesce(F.sum("rows"), F.lit(0))).alias("slots"),
                        F.coalesce(F.max("budget"), F.lit(0.0)).alias("all"))
    rows = with_scalars(queued, slots)
    entries = rows.where("size > 0").select(
        "size", "all", F.explode(F.array(*[
            F.struct(_slot(_entry(k), F.col("slots")).alias("slot"), _entry(k).alias("entry")) for k in range(repeats)])).alias("e")
    ).select("size", "all", "e.slot", "e.entry")
    so_far = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = entries.groupBy("slot").agg(F.sum("size").alias("held"), F.max("all").alias("all"))
    crossing = sums.withColumn("upto", F.sum("held").over(so_far)).where(F.col("upto") > F.col("all")).agg(
        F.min("slot").alias("cut_slot"), F.min(F.col("upto") - F.col("held")).alias("ahead"))
    crossing = written(crossing)
    last = with_scalars(entries, crossing).where(F.col("slot") == F.col("cut_slot"))
    in_order = Window.partitionBy("slot").orderBy("entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("upto", F.col("ahead") + F.sum("size").over(in_order)).where(
        F.col("upto") <= F.col("all")).agg(F.max("entry").alias("cut_entry"))
    rows = with_scalars(with_scalars(rows, crossing.select("cut_slot")), written(last))

    def taken(k: int) -> Column:
        slot = _slot(_entry(k), F.col("slots"))
        fits = F.col("cut_slot").isNull() | (slot < F.col("cut_slot")) | (
            (slot == F.col("cut_slot")) & F.coalesce(_entry(k) <= F.col("cut_entry"), F.lit(False)))
        return F.when((F.col("size") > 0) & fits, 1).otherwise(0)

    rounds = sum((taken(k) for k in range(1, repeats)), taken(0))
    out = rows.withColumn("rounds", rounds.cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "rounds", (F.col("rounds") * F.col("size")).alias("taken"),
                      (F.col("upto") / F.col("weight")).alias("finish"), F.col("weight"),
                      *[F.col(f"carry_{c}").alias(f"carry_{c}") for c in carry])


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, globally sorted by
    virtual finish time. Takes the settings of :func:`plan_mix`. ``docs`` is read twice and must give the same rows
    each time, as a written table does."""
    # rows are named by two hashes of all their values, the plan is made of names, and the texts join it once
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}
    whole = [F.to_json(F.struct(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in docs.columns]
    one, two, finish, again = fresh("one"), fresh("two"), fresh("finish"), fresh("again")
    named = docs.withColumns({one: F.xxhash64(F.lit(1), *whole, *[F.isnull(c) for c in whole]),
                              two: F.xxhash64(F.lit(2), *whole, *[F.isnull(c) for c in whole])})
    plan = plan_mix(named, carry=(one, two), **settings)
    taken = written(plan.select("finish", "source_size", "weight", "rounds", F.col(f"carry_{one}").alias("one"), F.col(f"carry_{two}").alias("two")))
    entry = F.explode(F.sequence(F.lit(0), F.col("rounds").cast("int") - 1)).alias("round")
    entries = taken.where("rounds > 0").select("one", "two", "finish", "source_size", "weight", entry).select(
        "one", "two", (F.col("finish") + F.col("round") * F.col("source_size") / F.col("weight")).alias(finish))
    equal = written(taken.groupBy("one", "two").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(
        "one", "two", F.lit(True).alias(again)))
    entries = written(entries.join(equal, ["one", "two"], "left"))
    same = (F.col(one) == F.col("one")) & (F.col(two) == F.col("two"))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], one, two, finish]
    once = named.join(entries.where(F.col(again).isNull()).drop(again), same).select(*columns)
    # equal rows are interchangeable: one of them stands for all
    several = named.join(equal.drop(again), same, "left_semi").dropDuplicates([one, two]).join(
        entries.where(again).drop(again), same).select(*columns)
    copies = once.union(several)
    return copies.repartitionByRange(finish, one, two).sortWithinPartitions(finish, one, two).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT row_number() OVER () AS k, doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|mix') AS draw FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM g),
v AS (SELECT *, [3, 1, 2][(place % 3) + 1] AS weight, 2 * source_size AS most, 1.5::DOUBLE * (SELECT sum(source_size) FROM g) AS budget FROM w),
e AS (SELECT *, most / weight AS ends FROM v),
f AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY ends, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ends, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS here FROM e),
t AS (SELECT *, coalesce((SELECT max(here) FROM f WHERE here <= ends), (SELECT max(ends) FROM f)) AS time FROM f),
q AS (SELECT s.k, s.doc_id, s.size, t.source_size, t.place, t.weight, t.budget, least(t.weight * t.time, t.most::DOUBLE) AS target,
    sum(s.size) OVER (PARTITION BY t.place ORDER BY draw, s.size, s.k ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
n AS (SELECT k, size, place, round, (upto + round * source_size) AS upto, (upto + round * source_size) / weight AS finish, budget
    FROM q, (VALUES (0), (1)) r(round) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, round, upto ROWS UNBOUNDED PRECEDING) AS all_upto FROM n),
x AS (SELECT k, sum(size)::BIGINT AS taken FROM c WHERE all_upto <= budget GROUP BY k)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN x USING (k)"""
