"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash to a few thousand virtual slots. Rows and bytes are summed per slot (a table of fixed size),
and a map from slot to shard is stored with a version number. The first version deals the slots in turn; from then
on the newest version is loaded, and growing or rebalancing edits it into the next: whole slots move, records never
hash anew.

Defined cases
    * null text has no bytes (a record still weighs ``overhead``); null ids hash with their text's checksum;
    * rows equal in id and text share a slot, and their order in the shard is theirs to swap;
    * empty table: empty result, and a map that still names a shard for every slot.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navloom.llm.common import cut_lineage, shared_path, text_or_empty


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[v]`` is the shard of virtual slot ``v``; edits return the next version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def dealt(cls, slots: int, shards: int) -> SlotMap:
        """The first version: slots to shards in turn, whatever they hold."""
        return cls(0, shards, tuple(v % shards for v in range(slots)))

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.shards
        for v, s in enumerate(self.shard_of):
            out[s] += slot_bytes[v]
        return out

    def grow(self, slot_bytes: list[int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest shards until it has its share; no other slot moves."""
        new, shard_of, loads = self.shards, list(self.shard_of), [*self.loads(slot_bytes), 0]
        own: list[list[int]] = [[] for _ in range(new)]
        for v in sorted(range(len(shard_of)), key=lambda v: (slot_bytes[v], -v)):
            own[shard_of[v]].append(v)
        share = sum(slot_bytes) / (new + 1)
        for _ in range(len(shard_of)):
            s = max((s for s in range(new) if own[s]), key=lambda s: (loads[s], -s), default=None)
            if s is None or loads[new] + slot_bytes[own[s][-1]] > share:
                break
            v = own[s].pop()
            shard_of[v] = new
            loads[s] -= slot_bytes[v]
            loads[new] += slot_bytes[v]
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def rebalance(self, slot_bytes: list[int], tolerance: float = 0.002) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that narrows a gap above ``tolerance`` of the mean.

        The same map comes back, with its version, if no slot has to move.
        """
        shard_of, loads = list(self.shard_of), self.loads(slot_bytes)
        mean = max(1.0, sum(loads) / self.shards)
        own: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for v, s in enumerate(shard_of):
            if slot_bytes[v]:
                insort(own[s], (slot_bytes[v], v))
        for _ in range(len(shard_of)):
            high, low = max(range(self.shards), key=lambda s: (loads[s], -s)), min(range(self.shards), key=lambda s: (loads[s], s))
            gap = loads[high] - loads[low]
            at = bisect_left(own[high], (gap / 2, -1))
            fits = [x for x in own[high][max(0, at - 1) : at + 1] if x[0] < gap]
            if gap <= tolerance * mean or not fits:
                break
            best = min(fits, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            own[high].remove(best)
            insort(own[low], best)
            shard_of[best[1]] = low
            loads[high] -= best[0]
            loads[low] += best[0]
        return SlotMap(self.version + 1, self.shards, tuple(shard_of)) if shard_of != list(self.shard_of) else self


def store_slot_map(spark: SparkSession, slots: SlotMap, path: str) -> None:
    """Write one version beside the earlier ones: ``path/version=N``."""
    rows = [(v, s, slots.shards) for v, s in enumerate(slots.shard_of)]
    spark.createDataFrame(rows, "vslot int, shard int, shards int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={slots.version}")


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under ``path``, ascending; none where nothing is stored yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
    # A version whose writing was cut short has no _SUCCESS beside its rows.
    whole = [p.getName() for p in found if p.getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in whole)


def load_slot_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The named version, else the newest."""
    version = stored_versions(spark, path)[-1] if version is None else version
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("vslot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def slotted(docs: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each record."""
    text = text_or_empty(text_col)
    crc = F.crc32(text)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), crc), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_totals(records: DataFrame, slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows per virtual slot: ``slots`` numbers each, however many records there are."""
    sums, rows = [0] * slots, [0] * slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        sums[r["vslot"]], rows[r["vslot"]] = r["size"], r["n"]
    return sums, rows


def current_map(spark: SparkSession, path: str, sums: list[int], shards: int) -> SlotMap:
    """The newest stored map, edited for these bytes per slot; each edit is stored as the next version.

    Without a stored map the slots are dealt in turn first. More shards than the map has are added one by one.
    """
    if not stored_versions(spark, path):
        store_slot_map(spark, SlotMap.dealt(len(sums), shards), path)
    slots = load_slot_map(spark, path)
    if len(slots.shard_of) != len(sums) or slots.shards > shards:
        raise ValueError("a stored map keeps its slots, and shards are only added")
    while slots.shards < shards:
        slots = slots.grow(sums)
        store_slot_map(spark, slots, path)
    even = slots.rebalance(sums)
    if even.version != slots.version:
        store_slot_map(spark, even, path)
    return load_slot_map(spark, path)


def assign_shards(docs: DataFrame, shards: int = 40, slots: int = 4096, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The law is ``bytes``. ``map_path`` is where versions are kept from run to run; without it the map is a new one.
    ``slot`` is the record's place in its shard: a virtual slot's places follow those of the shard's earlier
    virtual slots, so only records of one virtual slot are ever sorted together.
    """
    spark = docs.sparkSession
    records = cut_lineage(slotted(docs, slots))
    sums, rows = slot_totals(records, slots)
    current = current_map(spark, map_path or shared_path(spark, "slot-map"), sums, shards)
    base, nexts = [0] * slots, [0] * current.shards
    for v, s in enumerate(current.shard_of):
        base[v], nexts[s] = nexts[s], nexts[s] + rows[v]
    schema = T.StructType([T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("base", T.LongType())])
    places = spark.createDataFrame([(v, s, base[v]) for v, s in enumerate(current.shard_of)], schema)
    placed = records.selectExpr("*", "row_number() over (partition by vslot order by doc_id, text_crc32, size) - 1 as place")
    return placed.join(F.broadcast(places), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(current.version).alias("map_version"),
    )
