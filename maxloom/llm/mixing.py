"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in hash order, are cut into blocks. A source has an exact rate r of blocks per PERIOD, whole or not, and
p = ceil(r) turns in a period of P slots (the sum of all p, so PERIOD and at most one more per source). A source may take its
i-th turn (from 0) from slot floor(i P / p) on and must have taken it before slot ceil((i + 1) P / p). Earliest-deadline-first
over these windows fills every slot with a turn, and after any number of slots each source is less than one turn from its share.
The schedule repeats every P slots, so one period is made (a fold over P slots in one row) and every block finds its slot by
arithmetic and a lookup. Block b takes turn floor((b + phase) p / r), so turns beyond the exact rate are idle, evenly: a rare source
has one block every so many periods. Slots are an order; idle ones hold no rows.

No row is lost: without given weights the rates are proportional to the sources' blocks, so all of them last to the end and every
row is in the mix. With given weights the mix ends at the first slot whose source has no block left (`in_mix` tells,
`left_out` counts), as from there on the weights cannot be kept; rows beyond it keep their slot.

DataFrame functions only. Rows are numbered inside (source, hash bucket), and buckets' offsets are added, so a source that
holds a third of all rows is spread over all tasks. Broadcast: one period (at most MAX_PERIOD rows and one per source) and one row
per scheduled source (at most MAX_SOURCES). More sources than that share MAX_SOURCES lanes by their hash: a lane is scheduled like a source,
and in it rows stand by their place in their own source (as a fraction of its size), so each source is spread evenly over its lane.

Null source is a source of its own. Rows are ordered by a hash of the whole row (all columns but maps), so null and
repeated ids are spread and rows that differ have one order, also when a task runs again; rows equal in all are interchangeable.
Columns named like the results (PLACED) are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DOCS = 8
PERIOD = 1000
SEED = 20
MAX_PERIOD = 10_000
MAX_SOURCES = 1_000
BUCKET_ROWS = 16_384
#: Phases of sources in the middle half of a whole mix, a golden section apart, so equal sources don't all idle at once. A mix that ends has none, so a small source is in it.
GOLDEN = (5**0.5 - 1) / 2
PLACED = ("block", "place", "slot", "in_mix")


def rates(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, period: int) -> dict[str | None, float]:
    """Exact blocks per period of each source with a weight; default weights are the counts."""
    named = {s: float((weights or {}).get(s, 0.0)) if weights else float(n) for s, n in counts.items()}
    named = {s: w for s, w in named.items() if w > 0}
    total = sum(named.values())
    return {s: period * w / total for s, w in named.items()}


def shares(counts: Mapping[str | None, int], weights: Mapping[str | None, float] | None, period: int) -> dict[str | None, int]:
    """Turns per period: exact rates rounded up."""
    return {s: max(1, math.ceil(r - 1e-9)) for s, r in rates(counts, weights, period).items()}


def schedule_sql(slots: list[int]) -> str:
    """One period as SQL: the place in `slots` of the source that each slot goes to, by earliest deadline among released blocks."""
    period = sum(slots)
    p = f"array({', '.join(map(str, slots))})"
    open_blocks = f"""filter(transform({p}, (w, i) -> named_struct('due', CAST(ceil((acc.done[i] + 1) * {period} / w) AS INT), 'i', i, 'from', CAST(floor(acc.done[i] * {period} / w) AS INT), 'left', w - acc.done[i])), x -> x.from <= t AND x.left > 0)"""
    step = f"""transform(array(array_min({open_blocks})), k -> named_struct('done', transform(acc.done, (d, i) -> d + IF(i = k.i, 1, 0)), 'picks', concat(acc.picks, array(k.i))))[0]"""
    zero = f"named_struct('done', array_repeat(0, {len(slots)}), 'picks', CAST(array() AS ARRAY<INT>))"
    return f"aggregate(sequence(0, {period - 1}), {zero}, (acc, t) -> {step}, acc -> acc.picks)"


def _numbered(rows: DataFrame, order: str, n_rows: int) -> DataFrame:
    """`rows` with __index, the place of each among those of its __s in order of the long column `order`, and __size, how many there are."""
    bits = max(8, (n_rows // BUCKET_ROWS).bit_length())
    # A key that is never null, so that numbering and joining share one partitioning.
    rows = rows.withColumn("__k", F.coalesce(F.concat(F.lit("="), "__s"), F.lit(""))).withColumn("__bucket", F.shiftrightunsigned(F.col(order), 64 - bits))
    key = ["__k", "__bucket"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    every = Window.partitionBy("__k")
    sizes = sizes.select(*key, (F.sum("__n").over(every.orderBy("__bucket")) - F.col("__n")).alias("__before"), F.sum("__n").over(every).alias("__size"))
    # Unsigned, as buckets are: the sign bit is turned.
    own = Window.partitionBy(*key).orderBy(F.col(order).bitwiseXOR(F.lit(-(2**63))), "__digest")
    rows = rows.withColumn("__number", F.row_number().over(own) - 1).join(sizes, key)
    return rows.withColumn("__index", F.col("__number") + F.col("__before")).drop(*key, "__number", "__before")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, period: int = PERIOD, seed: int = SEED, max_sources: int = MAX_SOURCES) -> DataFrame:
    """`docs` with block (of its source), place (in the block), slot and in_mix; sources without weight are not in the mix and have null slots."""
    if period > MAX_PERIOD:
        raise ValueError(f"a period has at most {MAX_PERIOD} slots")
    if weights and len(weights) > max_sources:
        raise ValueError(f"weights for more than {max_sources} sources")
    spark = docs.sparkSession
    plain = [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    source = F.col(source_col).cast("string")
    rows = docs.withColumn("__s", source).withColumn("__digest", F.xxhash64(*plain)).withColumn("__h", F.xxhash64(F.col(id_col), "__digest", F.lit(seed)))
    counted = docs.groupBy(source.alias("s")).count()
    if weights:
        known = [s for s in weights if s is not None]
        counted = counted.where(F.col("s").isin(known) | (F.col("s").isNull() if None in weights else F.lit(False)))
    counts = {r["s"]: r["count"] for r in counted.limit(max_sources + 1).collect()}
    order = "__h"
    n_rows = sum(counts.values())
    if len(counts) > max_sources:
        n_rows = docs.count()
        # A row's place in its source, as a fraction of 2^64; the low bits keep rows of different sources apart.
        rows = _numbered(rows, "__h", n_rows).withColumn("__f", (F.col("__index") + 0.5) / F.col("__size"))
        high = F.floor(F.col("__f") * 2**40).cast("long")
        rows = rows.withColumn("__f", F.shiftleft(high, 24).bitwiseOR(F.shiftrightunsigned("__h", 40))).drop("__index", "__size")
        rows = rows.withColumn("__s", F.pmod(F.xxhash64(F.coalesce("__s", F.lit("")), F.lit(seed)), F.lit(max_sources)).cast("string"))
        counts = {r["s"]: r["count"] for r in rows.groupBy(F.col("__s").alias("s")).count().collect()}
        order = "__f"
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    slots, exact = shares(blocks, weights, period), rates(blocks, weights, period)
    names = sorted(slots, key=lambda s: (s is None, s or ""))
    kept = [c for c in docs.columns if c not in PLACED]
    if not names:
        return docs.select(*kept, *[F.lit(None).cast("long").alias(c) for c in ("block", "place", "slot")], F.lit(False).alias("in_mix"))
    one = spark.createDataFrame([(i, s, slots[s], max(1.0, slots[s] / exact[s]), blocks[s], 0.0 if weights else 0.25 + (0.5 + i * GOLDEN) % 1 / 2) for i, s in enumerate(names)], "i int, s string, p long, stride double, blocks long, phase double")
    period = sum(slots.values())
    turn = lambda block, prefix="": F.floor((F.col(block) + F.col(f"{prefix}phase")) * F.col(f"{prefix}stride"))
    plan = spark.range(1).select(F.posexplode(F.expr(schedule_sql([slots[s] for s in names]))).alias("at", "i"))
    plan = plan.select("at", "i", (F.row_number().over(Window.partitionBy("i").orderBy("at")) - 1).cast("long").alias("j"))
    inside = F.col("slot").isNotNull()
    if weights:
        # The first slot of a block that is not there, and the least of them over all sources.
        ends = one.withColumn("turn", turn("blocks")).withColumn("j", F.col("turn") % F.col("p"))
        inside = F.col("slot") < ends.join(F.broadcast(plan), ["i", "j"]).select(F.min(F.expr(f"turn div p * {period} + at")).alias("end")).first()["end"]
    placed = _numbered(rows, order, n_rows)
    placed = placed.select(*kept, F.col("__s").alias("__source"), F.expr(f"__index div {block_docs}").alias("block"), (F.col("__index") % block_docs).cast("long").alias("place"))
    placed = placed.join(F.broadcast(one.select(F.col("s").alias("__s"), F.col("i").alias("__i"), F.col("p").alias("__p"), F.col("stride").alias("__stride"), F.col("phase").alias("__phase"))), F.col("__source").eqNullSafe(F.col("__s")), "left")
    placed = placed.withColumn("__turn", turn("block", "__"))
    placed = placed.join(F.broadcast(plan.select(F.col("i").alias("__pi"), F.col("j").alias("__j"), F.col("at").alias("__at"))), (F.col("__i") == F.col("__pi")) & (F.col("__turn") % F.col("__p") == F.col("__j")), "left")
    placed = placed.withColumn("slot", F.expr(f"__turn div __p * {period} + __at"))
    return placed.select(*kept, "block", "place", "slot", F.coalesce(inside, F.lit(False)).alias("in_mix"))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of the mix alone, with the columns of `docs` (which are not named like the results)."""
    return mix(docs, weights, **options).where("in_mix").select(*docs.columns)


def left_out(placed: DataFrame, source_col: str = "source") -> DataFrame:
    """What the weights given to `mix` leave out of each source: source, n_rows, n_in_mix, n_left_out."""
    taken = F.sum(F.col("in_mix").cast("long"))
    return placed.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_rows"), taken.alias("n_in_mix"), (F.count("*") - taken).alias("n_left_out"))
