"""Shards of near equal bytes: sampled splitters, range partitions, exact offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediatimeline.llm.common import hash_unit, ids_and_texts
from mediatimeline.session import settle

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 1024  # beyond it ranges get longer, and their sorts spill; the splitters stay a bounded list on the driver
DRAWS_PER_RANGE = 64
WHOLE_GROUP_SHARE = 0.005  # of a shard; smaller groups of one key are never cut


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes + 1, null: 1), text_crc32 and key (hash of the text: equal texts are neighbours) of every row."""
    rows = ids_and_texts(docs, id_col, text_col)
    return rows.select("id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("key"))


def draw(rows: DataFrame, chance: Column, salt: int) -> list[tuple]:
    """Sampled (key, id, weight), drawn with `chance`, which is proportional to the size; chances over 1 become weights."""
    picked = rows.withColumn("chance", chance).where(hash_unit("key", "id", F.lit(salt)) < F.col("chance"))
    found = picked.select("key", "id", F.greatest("chance", F.lit(1.0)).alias("weight")).collect()
    return sorted(((r.key, r.id, r.weight) for r in found), key=lambda x: (x[0], x[1] is not None, x[1]))


def quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """(key, id) at the inner quantiles of the sample's weight. The id stays only where one key reaches over several parts."""
    total, run, marks = sum(w for _, _, w in sample), 0.0, []
    for key, ident, weight in sample:
        run += weight
        while len(marks) < parts - 1 and run >= total * (len(marks) + 1) / parts:
            marks.append((key, ident))
    keys = [key for key, _ in marks]
    return sorted({(k, i if keys.count(k) > 1 else None) for k, i in marks}, key=_order)


def _order(mark: tuple):
    return mark[0], mark[1] is not None, mark[1]


def range_of(marks: list[tuple], id_type: str) -> Column:
    """Number of splitters at or below a row's (key, id), by a two-step search in constant arrays."""
    if not marks:
        return F.lit(0)
    here = F.struct(F.col("key"), F.col("id"))
    width = math.isqrt(len(marks) - 1) + 1
    groups = [marks[i:i + width] for i in range(0, len(marks), width)]

    def array(items: list[tuple]) -> Column:
        return F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit(i).cast(id_type).alias("id")) for k, i in items])

    coarse = F.size(F.filter(array([g[0] for g in groups]), lambda m: m <= here))
    inside = F.element_at(F.array(*[array(g) for g in groups]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + F.size(F.filter(inside, lambda m: m <= here)))


def ranges(rows: DataFrame, parts: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows with their `range`, and (rows, bytes) of every range; overfull ranges are divided by a second, denser sample."""
    id_type = rows.schema["id"].dataType.simpleString()
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    marks = quantiles(draw(rows, F.col("size") * (DRAWS_PER_RANGE * parts / total), 0), parts)
    for salt in (1, 2, 3):
        ranged = rows.withColumn("range", range_of(marks, id_type))
        held = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}
        held = [held.get(i, (0, 0)) for i in range(len(marks) + 1)]
        # Parts that a range should have had, by its bytes or rows.
        want = [max(math.ceil(b * parts / total), math.ceil(n * parts / max(count, 1))) for n, b in held]
        over = [i for i, k in enumerate(want) if k > 2]
        if salt == 3 or not over:
            return ranged, held
        rate = [DRAWS_PER_RANGE * want[i] / held[i][1] if i in set(over) else 0.0 for i in range(len(held))]
        chance = F.col("size") * F.element_at(F.array(*[F.lit(x) for x in rate]), F.col("range") + 1)
        sample = draw(ranged, chance, salt)
        added: set[tuple] = set()
        for i in over:
            low = marks[i - 1] if i else None
            high = marks[i] if i < len(marks) else None
            inside = [s for s in sample if (low is None or _order(s[:2]) >= _order(low)) and (high is None or _order(s[:2]) < _order(high))]
            added.update(quantiles(inside, want[i]))
        more = sorted(set(marks) | added, key=_order)
        if len(more) == len(marks):
            return ranged, held
        marks = more
    raise AssertionError("not reached")


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`id_col`, size, text_crc32, law, shard, slot and grown_shard of every row; the law is `bytes`.

    One pass over the texts writes a narrow table. A sample of its (text hash, id) keys, drawn with chances in proportion
    to size, gives quantiles as splitters; the rows of each range are counted exactly and overfull ranges divided again.
    Inside a range a window adds up the bytes, and the ranges before it add an offset known from the counts, so every
    row's place among all bytes is exact. A row goes to the shard where its middle lies: shards differ by at most about
    one document or one small group. Equal texts are neighbours and stay in one shard, unless they hold more than
    WHOLE_GROUP_SHARE of a shard; the ranges of such a hot text are split by id. On the driver: at most
    DRAWS_PER_RANGE samples per range in expectation and MAX_RANGES counts.

    A null text has size 1, no checksum, and groups with other nulls. Null ids sort first. Repeated rows are as many rows,
    with slots of their own. An empty table gives an empty result. Other columns are not read. Reruns give the same rows.
    """
    rows = settle(sizes(docs, id_col, text_col))
    count = rows.count()
    parts = min(MAX_RANGES, max(4 * n_shards, math.ceil(count / rows_per_range)))
    ranged, held = ranges(rows, parts)
    total = max(1, sum(b for _, b in held))
    rows_before, bytes_before, n, b = [], [], 0, 0
    for more_n, more_b in held:
        rows_before.append(n)
        bytes_before.append(b)
        n, b = n + more_n, b + more_b

    def at(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("range") + 1)

    along = Window.partitionBy("range").orderBy("key", "id")
    group = Window.partitionBy("range", "key")
    start = F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = ranged.withColumn("start", start).withColumn("row", F.row_number().over(along))
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
    small = F.col("group_bytes") <= total / n_shards * WHOLE_GROUP_SHARE
    middle = F.when(small, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    number = F.least(F.lit(n_shards - 1), F.floor((at(bytes_before) + middle) * n_shards / total)).cast("int")
    placed = settle(placed.select("id", "size", "text_crc32", number.alias("shard"), (at(rows_before) + F.col("row") - 1).alias("place")))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
