"""Mixing sources to target weights (operator 4): Pfair scheduling of source blocks, in SQL functions only.

Every source's documents, in a hashed order, are cut into blocks.  Over "virtual time" a source of weight w consumes
one block every 1/w; when a source runs out the others go on in their proportions.  Mapped to slots, block k of a
source is released when the source's share reaches k blocks and due when it reaches k + 1, and earliest-deadline-first
gives every block a slot within its window: at any slot each source is less than one block off its share.

The schedule is made in frames of ``FRAME`` slots, in parallel.  At each frame's end every source's share is rounded
down or up so that the frame is full (largest remainders first), which fixes the blocks of each frame; earliest
deadline first within the frame is a fold over its slots.  Such a frame always has a feasible order, because the
shares themselves are one, fractionally.

Results: doc_id, source, block (within the source), slot (of the block in the mix) and position (of the document in
the mix, from 0).  A null source is a source of its own; null ids and repeated rows have positions like any others;
other columns are not read; an empty table gives an empty mix.  No document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, small, table

BLOCK, FRAME, BUCKET_ROWS = 8, 512, 20_000
#: A schedule of at most so many blocks (about 50 bytes each) is broadcast to the documents; a longer one is shuffled.
BROADCAST_SLOTS = 200_000
#: Production targets: a source's weight is its number of documents to this power, so large sources are flattened.
FLATTEN = 0.5
EPS = 1e-9


def _salt(docs: DataFrame) -> Column:
    """Tells rows without an id apart, by their text where there is one: else all of them would be one group."""
    text = docs["text"] if "text" in docs.columns else F.lit(None)
    return F.when(docs["doc_id"].isNull(), F.xxhash64(text.cast("string"))).otherwise(F.lit(0).cast("long"))


def ranked(docs: DataFrame, key: Column, bucket_rows: int = BUCKET_ROWS, salt: Column | None = None) -> DataFrame:
    """``docs`` with ``rank`` (0, 1, ...) within ``source`` in the order of the hash of ``key`` and ``salt``.

    Hash ranges split every source into buckets of about ``bucket_rows`` rows: only a bucket is sorted at once, and the
    ranks of earlier buckets come from a running sum over the few bucket counts.
    """
    hashed = docs.withColumn("h", F.xxhash64(key) if salt is None else F.xxhash64(key, salt))
    total = hashed.count()
    n = max(1, -(-total // bucket_rows))
    hashed = hashed.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 33), F.lit(n)).cast("int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("source", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("h", key)) - 1
    numbered = hashed.withColumn("own", own).join(sums.select("source", "bucket", "offset"), ["source", "bucket"])
    return numbered.withColumn("rank", F.col("offset") + F.col("own"))


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Of (source, docs, weight) one row: arrays over the sources, in the order in which they run out.

    Source i holds n[i] blocks and ends at virtual time v[i] = n[i] / w[i]; up to v[i] the sources from i on share the
    slots, so slots pass at rate rate[i] and t[i] slots have passed at v[i].
    """
    each = sources.select("source", F.ceil(F.col("docs") / block).alias("n"), (F.col("weight") / F.sum("weight").over(Window.partitionBy())).alias("w"))
    row = each.groupBy().agg(F.array_sort(F.collect_list(F.struct((F.col("n") / F.col("w")).alias("v"), "source", "n", "w"))).alias("s"))
    size = F.size("s")
    rate = F.transform("s", lambda _, i: F.aggregate(F.slice("s", i + 1, size - i), F.lit(0.0), lambda a, x: a + x["w"]))
    row = row.withColumn("rate", rate)
    last = lambda i: F.when(i == 0, 0.0).otherwise(F.get(F.col("s"), i - 1)["v"])
    step = F.transform("s", lambda x, i: (x["v"] - last(i)) * F.get(F.col("rate"), i))
    # At a phase's end a whole source is done, so slots passed add up to v * own rate + blocks of the sources that ended.
    return row.withColumn("step", step).withColumn("t", F.transform("step", lambda _, i: F.aggregate(F.slice("step", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x)))


def _virtual(slot: Column) -> Column:
    """Virtual time at a slot; needs the columns of ``plan``."""
    i = F.least(F.size(F.filter("t", lambda t: t < slot - EPS)), F.size("s") - 1)
    return F.when(i == 0, 0.0).otherwise(F.get(F.col("s"), i - 1)["v"]) + (slot - F.when(i == 0, 0.0).otherwise(F.get(F.col("t"), i - 1))) / F.get(F.col("rate"), i)


def _slot(v: Column) -> Column:
    """Slots passed at a virtual time."""
    i = F.least(F.size(F.filter("s", lambda x: x["v"] < v)), F.size("s") - 1)
    return F.when(i == 0, 0.0).otherwise(F.get(F.col("t"), i - 1)) + (v - F.when(i == 0, 0.0).otherwise(F.get(F.col("s"), i - 1)["v"])) * F.get(F.col("rate"), i)


def _rounded(slot: Column) -> Column:
    """Blocks of each source in the first ``slot`` slots: shares rounded down, then up by largest remainder until full."""
    v = _virtual(slot.cast("double"))
    share = F.transform("s", lambda x: F.least(x["w"] * v, x["n"].cast("double")))
    low = F.transform(share, lambda x: F.floor(x + EPS).cast("long"))
    missing = slot - F.aggregate(low, F.lit(0).cast("long"), lambda a, x: a + x)
    order = F.array_sort(F.transform(F.arrays_zip(share.alias("x"), low.alias("y")), lambda z, i: F.struct((z["y"] - z["x"]).alias("r"), i.alias("i"))))
    up = F.transform(F.slice(order, F.lit(1), F.greatest(missing, F.lit(0)).cast("int")), lambda z: z["i"])
    return F.transform(low, lambda x, i: x + F.when(F.array_contains(up, i), 1).otherwise(0))


def schedule(sources: DataFrame, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """source, block, slot of every block, by earliest deadline first within frames."""
    planned = plan(sources, block)
    slots = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    frames = planned.withColumn("slots", slots).where("slots > 0").withColumn("f", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / frame))))
    frames = frames.repartition("f").withColumn("first", F.col("f") * frame).withColumn("end", F.least(F.col("first") + frame, F.col("slots")))
    frames = frames.withColumn("from", _rounded(F.col("first"))).withColumn("to", _rounded(F.col("end")))
    jobs = F.flatten(
        F.transform(
            "s",
            lambda x, i: F.transform(
                F.filter(F.sequence(F.get(F.col("from"), i), F.get(F.col("to"), i)), lambda k: k < F.get(F.col("to"), i)),
                lambda k: F.struct(
                    F.ceil(_slot((k + 1) / x["w"]) - EPS).cast("long").alias("due"),
                    F.floor(_slot(k / x["w"]) + EPS).cast("long").alias("release"),
                    i.alias("i"),
                    k.alias("k"),
                ),
            ),
        )
    )
    # Sorted by deadline, the first job of each slot that is released is the one to run; what has run leaves the array.
    start = F.struct(F.array_sort(jobs).alias("left"), F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("done"))

    def run(acc: Column, slot: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda j: j["release"] <= slot), True)
        at = F.greatest(at, F.lit(1)).cast("int")
        job = F.get(acc["left"], at - 1)
        rest = F.concat(F.slice(acc["left"], F.lit(1), at - 1), F.slice(acc["left"], at + 1, F.size(acc["left"])))
        return F.struct(rest.alias("left"), F.concat(acc["done"], F.array(F.struct(job["i"].alias("i"), job["k"].alias("k"), slot.alias("slot")))).alias("done"))

    done = F.aggregate(F.sequence(F.col("first"), F.col("end") - 1), start, run, lambda acc: acc["done"])
    placed = frames.select("s", F.explode(done).alias("d"))
    return placed.select(F.get(F.col("s"), F.col("d.i"))["source"].alias("source"), F.col("d.k").alias("block"), F.col("d.slot").alias("slot"))


def weighted(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """source, docs, weight: the given weights (a source without one gets the smallest), or counts to the power ``flatten``."""
    counted = docs.groupBy("source").agg(F.count("*").alias("docs"))
    if not weights:
        return counted.withColumn("weight", F.pow(F.col("docs").cast("double"), F.lit(flatten)))
    given = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (f"={k}", float(w))))
    return counted.withColumn("weight", F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(min(weights.values())))))


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, frame: int = FRAME, flatten: float = FLATTEN, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, source, block, slot, position of every row, then the columns named in ``carry``."""
    # A null source takes part in joins under a name of its own.
    named = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), named.alias("source"), *(docs[f"`{c}`"].alias(c) for c in carry), _salt(docs).alias("salt"))
    sources = materialise(weighted(rows.select("doc_id", "source"), weights, flatten))
    slots = schedule(sources, block, frame)
    numbered = ranked(rows, F.col("doc_id"), salt=F.col("salt")).withColumn("block", F.floor(F.col("rank") / block))
    # Every block is full but the last of each source, so a position is the slot's less what last blocks before it lack:
    # summed within each frame, and over the frames before it.
    lack = F.when((F.col("docs") % block != 0) & (F.col("block") == F.floor(F.col("docs") / block)), block - F.col("docs") % block).otherwise(0)
    slots = slots.join(small(sources.select("source", "docs"), BROADCAST_SLOTS), "source").select("source", "block", "slot", lack.alias("lack"), F.floor(F.col("slot") / frame).alias("f"))
    slots = materialise(slots)
    earlier = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # a row for each frame
    frames = slots.groupBy("f").agg(F.sum("lack").alias("lack")).select("f", F.coalesce(F.sum("lack").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("f").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("within", F.coalesce(F.sum("lack").over(within), F.lit(0))).join(frames, "f")
    slots = slots.select("source", "block", "slot", (F.col("slot") * block - F.col("within") - F.col("before")).alias("begin"))
    out = numbered.join(small(slots, BROADCAST_SLOTS), ["source", "block"])
    source = F.when(F.col("source") != "", F.expr("substring(source, 2)")).alias("source")
    return out.select("doc_id", source, "block", "slot", (F.col("begin") + F.col("rank") - F.col("block") * block).alias("position"), *carry)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
