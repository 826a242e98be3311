"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.scratch import Scratch, unused

WORD = r"[^\x20\x09-\x0D]+"
#: A source's ranks are cut at one of this many hash prefixes; only rows of that prefix are ordered.
PREFIXES = 65536


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Targets for (source, weight, source_size): share * total by weight, no source over epochs * its size.

    Sources whose part of the level exceeds their cap are clamped to it, and what they pass on raises
    the level of the others by weight, until none is above. A round is an aggregate over the sources,
    however many there are; only two sums come to the driver. If all caps together fall short, every
    target is its cap.
    """
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, clamped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        row = s.agg(
            F.sum(F.when(full, F.col("cap"))).alias("caps"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if row["open"] is None or row["clamped"] == clamped:
            break
        level, clamped = (total - (row["caps"] or 0.0)) / row["open"], row["clamped"]
    return s.select("source", "weight", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def by_code_point(sources: DataFrame, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """Adds ``weight``: the given weights in turn over the sources by code point, null last.

    Sources are ordered range by range, and a range's first place is the number of sources ahead of it.
    """
    bits = 33  # monotonically_increasing_id: the partition above, the row in it below
    order = [F.col("source").isNull(), F.col("source")]
    ranges = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = scratch.save(ranges, "ranges")
    part, ahead, firsts = F.shiftright("at", bits), 0, []
    for r in sorted(ranges.groupBy(part.alias("part")).count().collect()):  # one row a partition
        firsts.append((r["part"], ahead))
        ahead += r["count"]
    firsts = F.broadcast(sources.sparkSession.createDataFrame(firsts, "part long, ahead long"))
    placed = ranges.withColumn("part", part).join(firsts, "part").withColumn("i", F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << bits) - 1)))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    return placed.select(*sources.columns, turn.alias("weight"))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """doc_id, source, size in words (null text: 0), and the seeded order: a 128-bit hex rank."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.col(doc_id).cast("string"))).alias("rank"),
    )


def mix(
    docs: DataFrame,
    scratch: Scratch,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    epochs: float = 2.0,
    seed: str = "mix-1",
    **columns: str,
) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken.

    Every document is taken whole as often as target / source_size goes into it; the fraction left is
    made up of documents in seeded order, the last of them in part, so that a source's sum is its
    target to the word. The order is by a hash of seed and doc_id, thus the same on each run. Sums by
    source and hash prefix give the cut, and only the rows of the one prefix that holds it are ordered.
    Null sources are one source; null or empty texts have size 0 and take 0; a document row that repeats
    a doc_id ties by size and shares its place; an empty table gives no row.
    """
    s = scratch.save(sized(docs, seed=seed, **columns), "sizes")
    prefix = F.conv(F.substring("rank", 1, 4), 16, 10).cast("int")
    parts = s.groupBy("source", prefix.alias("p")).agg(F.sum("size").alias("n"))
    sources = s.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        water_fill(scratch.save(by_code_point(sources, weights, scratch), "weights"), share, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    )
    plan = scratch.save(plan, "plan")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # the prefix in which each source's cut lies, and the words ahead of it
    run = parts.withColumn("ahead", F.sum("n").over(W.partitionBy("source").orderBy("p")) - F.col("n"))
    cut = (
        run.withColumnRenamed("source", "run_source").join(plan, same("run_source", "source"))
        .where((F.col("ahead") <= F.col("part")) & (F.col("ahead") + F.col("n") > F.col("part")))
        .select("source", F.col("p").alias("cut_p"), "ahead")
    )
    plan = scratch.save(plan.join(cut.withColumnRenamed("source", "cut_source"), same("cut_source", "source"), "left").drop("cut_source"), "cuts")
    small = plan.count() <= 10_000
    plan = plan.withColumnRenamed("source", "plan_source")
    rows = s.withColumn("p", prefix).join(F.broadcast(plan) if small else plan, same("source", "plan_source"), "left").drop("plan_source")
    inside = F.col("p") == F.col("cut_p")
    ordered = W.partitionBy("source").orderBy("rank", "size").rowsBetween(W.unboundedPreceding, -1)
    # cut_p is null if the fraction takes all of the source or the source is empty
    extra_outside = (
        F.when(F.col("cut_p").isNull() & (F.col("part") > 0), F.col("size"))
        .when(F.col("p") < F.col("cut_p"), F.col("size"))
        .otherwise(F.lit(0))
    )
    outside = rows.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", extra_outside)
    at_cut = rows.where(inside).withColumn(
        "extra",
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("ahead") - F.coalesce(F.sum("size").over(ordered), F.lit(0)))),
    )
    return outside.unionByName(at_cut).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixed rows, with the columns of ``docs``: each document as many whole times as it is taken, then its first words for the rest.

    Documents of size 0 take nothing and go. Rows that repeat a doc_id, source and size are one to the
    mix: what they take together is dealt over them in order of their text, to the word. ``n_chars``
    follows the text. Columns of any name pass through.
    """
    names = unused(docs.columns, "id", "source", "size", "all", "rows", "taken", "n", "copy")
    own_id, own_source, own_size, every, many, taken, n, copy = names
    share = mix(docs, scratch, **options).groupBy(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(own_size))
    share = share.agg(F.sum("taken").alias(every), F.count("*").alias(many)).where(F.col(every) > 0)
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col("source").eqNullSafe(F.col(own_source)) & (F.col(n) == F.col(own_size))
    rows = docs.withColumn(n, size)
    once = rows.join(share.where(F.col(many) == 1), same).withColumn(taken, F.col(every))
    again = scratch.save(share.where(F.col(many) > 1), "again")
    if not again.isEmpty():
        place = F.row_number().over(W.partitionBy(own_id, own_source, own_size).orderBy("text"))
        dealt = lambda k: F.floor(F.col(every) * k / F.col(many))
        once = once.union(rows.join(again, same).withColumn(taken, dealt(place) - dealt(place - 1)))
    rows = once.where(F.col(taken) > 0)
    whole, rest = F.floor(F.col(taken) / F.col(n)).cast("int"), (F.col(taken) % F.col(n)).cast("int")
    lead = F.regexp_extract("text", r"^[\x20\x09-\x0D]*", 0)
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    head = F.regexp_replace(F.concat(lead, F.array_join(F.slice(pieces, F.lit(1), rest), "")), r"[\x20\x09-\x0D]+$", "")
    copies = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn(copy, F.explode(copies)).withColumn("text", F.col(copy))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
