"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put in blocks.  Block j (from 0) of a source with share w
of the slots is released at floor(j / w) and due at ceil((j + 1) / w).  Giving
each slot to the released block that is due first keeps the blocks that any
source has had within one of w * t at every slot t.

Shares are whole numbers of one ``UNIT``-th of all, so releases and deadlines
are exact and the schedule keeps to the target on any length.  One row holds
the sources and a fold over the slots writes the schedule; its work is slots
times sources.  ``slots`` bounds the blocks: blocks grow with the table, so
however many rows there are, the schedule has at most ``slots`` of them and one
for each source.

When a source runs dry, a new round without it starts, so no slot stays empty;
sources of weight 0 come after all others, by their sizes.  No row is dropped or
repeated: ``in_target`` marks what stands before the first source runs dry,
where the target weights hold.

Edge cases: null sources are a source of their own; repeated rows and null ids
are rows like any other; an empty table gives no rows; a source may hold most
rows, since rows are numbered in hash ranges; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, let, written

#: Stands for a null source, in no source's name by its length of one control character.
NO_SOURCE = "\x00"
#: Shares are counted in parts of this; times the slots it stays below 2 ** 63.
UNIT = 1 << 40
#: Slots that the fold writes to one list before it starts the next.
STRETCH = 256
#: Most rows of a schedule that is broadcast, some MB; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def div(a: Column, b: Column) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b)


def tickets(weights: Column) -> Column:
    """Shares of a list of weights, in units; a weight above 0 has one unit at least."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(weights, lambda w: F.when(w > 0, F.greatest(F.lit(1), F.floor(w / t * UNIT + 0.5))).otherwise(F.lit(0)).cast("long")))


def source_row(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, block: int) -> DataFrame:
    """One row: ``s``, the sources in order with size, blocks, tickets ``p``, and ``q`` by size; none without sources."""
    by_size = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    named = by_size
    if weights and any(weights.values()):
        named = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("__src")], F.lit(0.0))
    one = sizes.select("__src", "n", named.alias("w"), by_size.alias("v")).agg(F.sort_array(F.collect_list(F.struct("__src", "n", "w", "v"))).alias("s")).where(F.size("s") > 0)
    one = one.select("s", tickets(F.transform("s", lambda x: x["w"])).alias("p"), tickets(F.transform("s", lambda x: x["v"])).alias("q"))
    blocks = lambda n: div(n + (block - 1), F.lit(block).cast("long"))
    return one.select(F.transform("s", lambda x, i: F.struct(x["__src"].alias("src"), x["n"].alias("n"), blocks(x["n"]).alias("blocks"), F.get("p", i).alias("p"), F.get("q", i).alias("q"))).alias("s"))


def edf(s: Column, block: int) -> Column:
    """The picks of all slots, earliest deadline first among released blocks: (source index, block, rows before it, in target)."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda a, y: a + y)
    kind = "array<struct<i:int,block:bigint,first:bigint,ok:boolean>>"

    def state(had: Column, t: Column, whole: Column, late: Column, first: Column, ok: Column, picks: Column) -> Column:
        return F.struct(had.alias("had"), t.alias("t"), whole.alias("whole"), late.alias("late"), first.alias("first"), ok.alias("ok"), picks.alias("picks"))

    def step(acc: Column, _: Column) -> Column:
        def due(x: Column, i: Column) -> Column:
            h = F.get(acc["had"], i)
            w = F.when(acc["late"], x["q"]).otherwise(x["p"])
            safe = F.greatest(w, one)
            released = (w > 0) & (h["done"] < x["blocks"]) & (div(h["turn"] * acc["whole"], safe) <= acc["t"])
            return F.when(released, F.struct(div((h["turn"] + 1) * acc["whole"] + safe - 1, safe).alias("d"), i.alias("i")))

        return let(F.array_min(F.transform(s, due))["i"], lambda pick: picked(acc, pick))

    def picked(acc: Column, pick: Column) -> Column:
        x, h = F.get(s, pick), F.get(acc["had"], pick)
        dry = h["done"] + 1 >= x["blocks"]
        had = F.transform(acc["had"], lambda y, i: F.struct((y["done"] + (i == pick).cast("long")).alias("done"), F.when(dry, zero).otherwise(y["turn"] + (i == pick).cast("long")).alias("turn")))
        entry = F.struct(pick.cast("int").alias("i"), h["done"].alias("block"), acc["first"].alias("first"), acc["ok"].alias("ok"))
        first = acc["first"] + F.least(F.lit(block).cast("long"), x["n"] - h["done"] * F.lit(block).cast("long"))
        picks = F.concat(acc["picks"], F.array(entry))

        def rest(had: Column) -> Column:
            live = lambda part: total(F.transform(s, lambda y, i: F.when(F.get(had, i)["done"] < y["blocks"], y[part]).otherwise(zero)))
            late = F.when(dry, acc["late"] | (live("p") == 0)).otherwise(acc["late"])
            whole = F.when(dry, F.when(late, live("q")).otherwise(live("p"))).otherwise(acc["whole"])
            return state(had, F.when(dry, zero).otherwise(acc["t"] + 1), whole, late, first, acc["ok"] & ~dry, picks)

        return let(had, rest)

    none = F.array().cast(kind)
    start = state(F.transform(s, lambda _: F.struct(zero.alias("done"), zero.alias("turn"))), zero, total(F.transform(s, lambda x: x["p"])), F.lit(False), zero, F.lit(True), none)
    slots = total(F.transform(s, lambda x: x["blocks"]))

    def stretch(acc: Column, k: Column) -> Column:
        own = F.sequence(k * STRETCH, F.least(slots, (k + 1) * STRETCH) - 1)
        begin = F.struct(*[acc["now"][c].alias(c) for c in ("had", "t", "whole", "late", "first", "ok")], none.alias("picks"))
        return let(F.aggregate(own, begin, step), lambda now: F.struct(now.alias("now"), F.concat(acc["lists"], F.array(now["picks"])).alias("lists")))

    begin = F.struct(start.alias("now"), F.array().cast(f"array<{kind}>").alias("lists"))
    return F.flatten(F.aggregate(F.sequence(zero, div(slots - 1, F.lit(STRETCH).cast("long"))), begin, stretch, lambda acc: acc["lists"]))


def schedule(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, block: int) -> DataFrame:
    """One row for each block of each source, by slot."""
    one = source_row(sizes, weights, alpha, block)
    slots = one.select("s", F.posexplode(edf(F.col("s"), block)).alias("slot", "pick"))
    own = F.get("s", F.col("pick.i"))
    share = own["p"] / F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["p"])
    return slots.select(own["src"].alias("__src_s"), F.col("pick.block").alias("__block_s"), F.col("slot").cast("long").alias("mix_slot"), F.col("pick.first").alias("__first"), share.alias("target_weight"), F.col("pick.ok").alias("in_target"))


def mixed(df: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, block_rows: int = 16, slots: int = 1 << 16, id_col: str = "doc_id", source_col: str = "source", sub_digits: int = 3) -> DataFrame:
    """``df`` with its place in the mix: ``block``, ``mix_slot``, ``position`` (gapless from 0), ``target_weight``, ``in_target``.

    Weights are named in ``weights``, else rows ** ``alpha``.  Blocks have
    ``block_rows`` rows, or as many as keep them to ``slots``.  Rows of a source
    come in order of md5(id), numbered in 16 ** ``sub_digits`` ranges of it.  The
    rows are shuffled once, by (source, hash range).
    """
    keep = df.columns
    row = df.select(F.struct(*[F.col(c) for c in keep]).alias("__row"), F.coalesce(F.col(source_col), F.lit(NO_SOURCE)).alias("__src"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("__h"), F.col(id_col).alias("__id"))
    row = row.withColumn("__sub", F.substring("__h", 1, sub_digits))
    sizes = written(row.groupBy("__src").agg(F.count(F.lit(1)).alias("n")))
    rows, sources = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(block_rows, -(-rows // slots))
    plan = written(schedule(sizes, weights, alpha, block))
    if slots + sources <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    r = gapless(row, ["__src"], "__sub", ["__h", "__id"], "__idx").withColumn("block", div(F.col("__idx").cast("long"), F.lit(block).cast("long")))
    r = r.join(plan, (F.col("__src") == F.col("__src_s")) & (F.col("block") == F.col("__block_s")))
    return r.select("__row.*", "block", "mix_slot", (F.col("__first") + F.col("__idx") % block).cast("long").alias("position"), "target_weight", "in_target")


def in_mix_order(df: DataFrame, position: str = "mix_position", **options: object) -> DataFrame:
    """``df`` with its place in the mix in the column ``position``, dealt to contiguous ranges of it and sorted.

    Written as it is, its files in order of name hold the mix from first to
    last, so a reader that follows the files sees the target weights too.
    """
    names = [c for c in df.columns if c != position]
    packed = df.select(F.struct(*[F.col(c) for c in names]).alias("__doc"), F.col(str(options.get("id_col", "doc_id"))).alias("__id"), F.col(str(options.get("source_col", "source"))).alias("__source"))
    m = mixed(packed, **{**options, "id_col": "__id", "source_col": "__source"}).select("__doc", "position")
    return m.repartitionByRange("position").sortWithinPartitions("position").select("__doc.*", F.col("position").alias(position))
