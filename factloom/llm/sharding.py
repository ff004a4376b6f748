"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots, thousands of them; bytes and rows are summed by slot, and a versioned
map assigns slots to shards.  The map is a table: every version is written once, and the newest is read back and used.
Rows that are the same are numbered, and all but the first are hashed with their number, so that they spread as well.
Growing or rebalancing edits it into a next version: a record's slot never changes, and only whole slots move.  The map
has one row a slot, whatever the corpus; it is the only thing that is collected or broadcast.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shared import saved

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """version; shard, bytes and rows of each slot."""

    version: int
    shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for s, b in zip(self.shard, self.size, strict=True):
            out[s] += b
        return out

    def rows_before(self) -> list[int]:
        """For each slot, the rows of its shard's earlier slots."""
        seen, out = [0] * self.shards, []
        for s, n in zip(self.shard, self.rows, strict=True):
            out.append(seen[s])
            seen[s] += n
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.shard)), self.shard, self.rows_before(), self.size, strict=True))
        table = spark.createDataFrame(rows, "virtual_slot int, shard int, rows_before long, slot_bytes long")
        return table.withColumn("version", F.lit(self.version))


def first_map(size: list[int], rows: list[int], shards: int) -> SlotMap:
    """Version 1: slots from the largest on, each to the shard with the fewest bytes so far, and fewest slots in a tie."""
    heap = [(0, 0, s) for s in range(shards)]
    shard = [0] * len(size)
    for slot in sorted(range(len(size)), key=lambda x: (-size[x], x)):
        load, held, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + size[slot], held + 1, s))
    return SlotMap(1, shards, tuple(shard), tuple(size), tuple(rows))


def grown(old: SlotMap) -> SlotMap:
    """The next version, with one more shard, which takes whole slots from the fullest shards; no other slot moves."""
    new, shard = old.shards, list(old.shard)
    loads = old.loads()
    own: list[list[int]] = [[] for _ in loads]
    for slot, s in sorted(enumerate(shard), key=lambda x: old.size[x[0]]):
        own[s].append(slot)
    want, got = sum(loads) / (new + 1), 0
    heap = [(-b, s) for s, b in enumerate(loads)]
    heapq.heapify(heap)
    while heap:
        load, s = heapq.heappop(heap)
        if not own[s] or -load <= want:
            break
        slot = own[s].pop()
        if got + old.size[slot] <= want:
            shard[slot] = new
            got += old.size[slot]
            load += old.size[slot]
        heapq.heappush(heap, (load, s))
    return SlotMap(old.version + 1, new + 1, tuple(shard), old.size, old.rows)


def rebalanced(old: SlotMap, size: list[int], rows: list[int], tolerance: float = 0.02) -> SlotMap:
    """The next version for new sizes: slots move from the fullest shard to the emptiest, each time the largest that narrows
    the two, until the fullest holds at most 1 + tolerance times the mean or no slot narrows them.  The old one, with the
    new sizes, if none has to move."""
    shard = list(old.shard)
    now = SlotMap(old.version, old.shards, old.shard, tuple(size), tuple(rows))
    loads = now.loads()
    own: list[list[tuple[int, int]]] = [[] for _ in loads]
    for slot, s in enumerate(shard):
        own[s].append((size[slot], slot))
    for x in own:
        x.sort()
    mean = sum(loads) / len(loads)
    while max(loads) > (1 + tolerance) * mean:
        a, b = loads.index(max(loads)), loads.index(min(loads))
        i = bisect_left(own[a], ((loads[a] - loads[b] + 1) // 2 + 1, 0)) - 1  # the largest of at most half the difference
        if i < 0 or own[a][i][0] == 0:
            break
        n, slot = own[a].pop(i)
        insort(own[b], (n, slot))
        shard[slot] = b
        loads[a] -= n
        loads[b] += n
    return now if shard == list(old.shard) else SlotMap(old.version + 1, old.shards, tuple(shard), tuple(size), tuple(rows))


def shrunk(old: SlotMap, shards: int) -> SlotMap:
    """The next version, with fewer shards: the slots of those that go move, largest first, to the lightest of the others."""
    shard, loads = list(old.shard), old.loads()
    heap = [(load, s) for s, load in enumerate(loads[:shards])]
    heapq.heapify(heap)
    for slot in sorted((i for i, s in enumerate(shard) if s >= shards), key=lambda i: (-old.size[i], i)):
        load, s = heapq.heappop(heap)
        shard[slot] = s
        heapq.heappush(heap, (load + old.size[slot], s))
    return SlotMap(old.version + 1, shards, tuple(shard), old.size, old.rows)


def stored(spark: SparkSession, folder: str, slot_map: SlotMap) -> SlotMap:
    """Write a version beside the others, whole or not at all; one that is there stays as it is, and is what counts."""
    rows = [(i, s, b, n) for i, (s, b, n) in enumerate(zip(slot_map.shard, slot_map.size, slot_map.rows, strict=True))]
    table = spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long, n_rows long").withColumn("shards", F.lit(slot_map.shards))
    waiting, version = f"{folder}/_new-{uuid.uuid4().hex}", f"{folder}/version={slot_map.version}"
    table.coalesce(1).write.parquet(waiting)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(waiting), hadoop.Path(version)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        if not fs.exists(target):
            hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(source), fs.makeQualified(target), never)
    except Exception:  # another run was first, or the folder cannot be written
        if not fs.exists(target):
            raise
    fs.delete(source, True)
    return latest(spark, folder, slot_map.version)


def latest(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap | None:
    """The newest version, if there is any, or one by number."""
    try:
        table = spark.read.parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):  # only folders of runs that were lost
            raise
        return None
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    newest = table.where(F.col("version") == version).orderBy("virtual_slot").collect()  # a row a slot
    return SlotMap(newest[0]["version"], newest[0]["shards"], *(tuple(r[c] for r in newest) for c in ("shard", "bytes", "n_rows")))


def sized(documents: DataFrame, overhead: int, slots: int) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row, written once, so that all that follows sees the same numbers.

    Rows with the same id and text are numbered without being brought together: by their place in their partition, after
    those of the partitions before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    docs = saved(docs.withColumns({"same": F.xxhash64("doc_id", "text_crc32"), "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    by_part = docs.groupBy("same", "part").agg(F.count(F.lit(1)).alias("n"))
    often = by_part.groupBy("same").agg(F.sum("n").alias("all")).where("all > 1").select("same")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = saved(by_part.join(often, "same", "left_semi").select("same", "part", before.alias("before")))
    within = F.row_number().over(Window.partitionBy("same", "part").orderBy("row")) - 1
    copies = docs.join(before, ["same", "part"]).withColumn("number", F.col("before") + within).select("row", "number").where("number > 0")
    numbered = docs.join(copies, "row", "left")
    slot = F.when(F.col("number").isNull(), F.col("same")).otherwise(F.xxhash64("doc_id", "text_crc32", "number"))
    return saved(numbered.select("doc_id", "size", "text_crc32", F.pmod(slot, F.lit(slots)).cast("int").alias("virtual_slot")))


def slot_totals(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of every slot."""
    size, rows = [0] * slots, [0] * slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def store_map(documents: DataFrame, maps: str, shards: int, slots: int = SLOTS, overhead: int = 16) -> SlotMap:
    """Store the first version of a map for these records."""
    return stored(documents.sparkSession, maps, first_map(*slot_totals(sized(documents, overhead, slots), slots), shards))


def sharded(documents: DataFrame, shards: int = 40, slots: int = SLOTS, overhead: int = 16, slot_map: SlotMap | None = None, maps: str | None = None) -> DataFrame:
    """Put every record into a shard of near equal bytes.

    Returns doc_id, size (bytes of the text plus overhead), text_crc32, law ("bytes"), shard, slot (the record's place
    in its shard, from 0 without gaps), grown_shard (null: this law does not promise one), virtual_slot and
    map_version.  Null texts count as empty.  Null doc_ids are hashed like others.  Repeated rows are numbered and
    spread over the slots; they are alike, so which of them goes where says nothing.  An empty table gives an empty result.
    Only doc_id and text are read.
    maps: folder of the stored map.  Its newest version is used, edited first where it has more or fewer shards than asked
    for or the records have grown uneven; without one the first version is made from the records and stored.  A stored map
    with another number of slots is refused: records cannot change slots.
    slot_map: a map to use as it is.
    """
    records = sized(documents, overhead, slots)
    size, rows = slot_totals(records, slots)
    spark = documents.sparkSession
    if slot_map is None and maps is not None:
        slot_map = latest(spark, maps) or stored(spark, maps, first_map(size, rows, shards))
        if len(slot_map.shard) != slots:
            raise ValueError(f"the map in {maps} has {len(slot_map.shard)} slots, not {slots}")
        edited = slot_map = SlotMap(slot_map.version, slot_map.shards, slot_map.shard, tuple(size), tuple(rows))
        while edited.shards < shards:
            edited = grown(edited)
        if edited.shards > shards:
            edited = shrunk(edited, shards)
        edited = rebalanced(edited, size, rows)
        slot_map = slot_map if (edited.shard, edited.shards) == (slot_map.shard, slot_map.shards) else stored(spark, maps, replace(edited, version=slot_map.version + 1))
    elif slot_map is None:
        slot_map = first_map(size, rows, shards)
    else:
        if len(slot_map.shard) != slots:
            raise ValueError(f"the map has {len(slot_map.shard)} slots, not {slots}")
        slot_map = SlotMap(slot_map.version, slot_map.shards, slot_map.shard, tuple(size), tuple(rows))
    places = F.broadcast(slot_map.frame(documents.sparkSession))
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    return (
        records.withColumn("within", within)
        .join(places, "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("rows_before") + F.col("within")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
