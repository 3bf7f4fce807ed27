"""Train, validation and test splits in which related events never part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skysieve.functions.keys import event_key, message_key, with_pair_key
from skysieve.llm.forest import spanning_forest
from skysieve.session import cut, stored

#: Ranges of the hash by which the groups of a size band are ranked without a window over the whole band.
RANGES = 4096


def keyed_records(collection: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    rows = with_pair_key(collection, aliases)
    return rows.select("record_no", event_key(F.col("event_id")).alias("event"), "pair_key", message_key(F.col("source_message_id")).alias("message_key"))


def key_uses(keyed: DataFrame) -> DataFrame:
    """key, event: which events use each pair of objects and each message identifier, each once."""
    keys = F.array(F.when(F.col("pair_key").isNotNull(), F.concat(F.lit("p:"), "pair_key")), F.when(F.col("message_key").isNotNull(), F.concat(F.lit("m:"), "message_key")))
    return (
        keyed.filter(F.col("event").isNotNull()).select("event", F.explode(F.array_compact(keys)).alias("key"))
        .groupBy("key", "event").agg(F.count(F.lit(1)).alias("n"))
    )


def relation_links(keyed: DataFrame) -> DataFrame:
    """a, b: for each pair of objects and each message identifier with several events, its least event with each other one; not
    all pairs of events within a key."""
    uses = key_uses(keyed)
    shared = uses.groupBy("key").agg(F.min("event").alias("a"), F.max("event").alias("last")).filter("a <> last").select("key", "a")
    return uses.select("key", F.col("event").alias("b")).join(shared, "key").filter("a <> b").select("a", "b").distinct()


def related_groups(collection: DataFrame, aliases: DataFrame | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, forest). members: event, group_id (the least event of the group) for every event related to another one. forest: the
    persisted links u, v that hold the groups together.

    Events are related by a shared pair of identified objects (any order or spelling, aliases resolved) or a shared usable
    message identifier, and relation carries over. Records without a usable event_id are left out; null keys relate nothing;
    repeated rows change nothing; an empty table gives no groups; other columns are not read."""
    links = relation_links(keyed_records(collection, aliases))
    forest, members = spanning_forest(links, "a", "b", path)
    return _grouped(members), forest


def _grouped(members: DataFrame) -> DataFrame:
    """event, group_id: the least event of each component."""
    members = cut(members)
    least = members.groupBy("root").agg(F.min("node").alias("group_id"))
    return members.join(least, "root").select(F.col("node").alias("event"), "group_id")


class RelatedEvents:
    """Related events over deliveries, in two tables that outlast the session: keys (each pair of objects and identifier with the event that first
    used it) and the forest of links that hold the groups together, of which each delivery writes a new generation. A delivery reads keys and
    links, and never the records of earlier ones. The rules are those of `related_groups`."""

    def __init__(self, spark: SparkSession, path: str, aliases: DataFrame | None = None) -> None:
        self.spark, self.path, self.aliases = spark, path, aliases
        for name, schema in (("keys", "key string, event string"), ("forest/generation=0", "u string, v string")):
            if not self._exists(name):
                spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _generation(self) -> int:
        number = 0
        while self._exists(f"forest/generation={number + 1}/_SUCCESS"):
            number += 1
        return number

    def forest(self) -> DataFrame:
        return self.spark.read.schema("u string, v string").parquet(f"{self.path}/forest/generation={self._generation()}")

    def accept(self, records: DataFrame) -> None:
        """Link the events of a delivery with each other and with those of earlier ones. A delivery that is accepted again changes nothing."""
        uses = key_uses(keyed_records(records, self.aliases))
        known = self.spark.read.schema("key string, event string").parquet(f"{self.path}/keys").withColumnRenamed("event", "owner")
        first = stored(uses.groupBy("key").agg(F.min("event").alias("a")).join(known, "key", "left"), "first-uses")
        owners = first.select("key", F.coalesce("owner", "a").alias("a"))
        links = uses.select("key", F.col("event").alias("b")).join(owners, "key").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
        spanning_forest(self.forest().unionByName(links), "u", "v", f"{self.path}/forest/generation={self._generation() + 1}")
        first.filter("owner is null").select("key", F.col("a").alias("event")).write.mode("append").parquet(f"{self.path}/keys")

    def groups(self) -> DataFrame:
        """event, group_id of every event related to another one."""
        return _grouped(spanning_forest(self.forest(), "u", "v")[1])


def _edges(lack: dict[str, float]) -> list[tuple[str, float]]:
    """Parts with the point up to which they reach on a line from 0 to 1 along which they take what they lack."""
    open_ = {part: max(0.0, rows) for part, rows in lack.items()}
    whole, reached, out = sum(open_.values()), 0.0, []
    for part, rows in open_.items():
        reached += rows / whole if whole else 1 / len(open_)
        out.append((part, reached))
    return out


def _part_at(point: Column, edges: list[tuple[str, float]]) -> Column:
    column = F.lit(max(edges, key=lambda e: e[1])[0])
    for part, edge in reversed(edges[:-1]):
        column = F.when(point < edge, F.lit(part)).otherwise(column)
    return column


def assign_parts(groups: DataFrame, plan: DataFrame, seed: str = "split-1") -> DataFrame:
    """group_id, split_part for groups (group_id, n_rows) by the shares of `plan` (split_part, target_pct).

    Groups are stratified by size band (powers of two), laid end to end within a band in the order of a hash, and dealt systematically:
    the middle of a group, as a share of the band's rows, is compared with the cumulative shares of the parts. Bands are dealt
    from the largest size to the smallest, each by the shares that the parts still lack of all rows, so what large groups leave
    uneven the smaller ones level. The driver sees one sum per band and part; there are at most 63 bands. Places along a band come
    from sums per range of the hash, so no task holds a band. A plan without a positive share gives every group a null part."""
    wanted = {r["split_part"]: float(r["target_pct"]) for r in plan.filter("split_part is not null and target_pct > 0").groupBy("split_part").agg(F.max("target_pct").alias("target_pct")).collect()}
    if not wanted:
        return groups.select("group_id", F.lit(None).cast("string").alias("split_part"))
    ranged = groups.withColumn("band", F.floor(F.log2(F.col("n_rows").cast("double"))).cast("int")).withColumn("h", F.xxhash64(F.lit(seed), "group_id")).withColumn("range", F.pmod("h", F.lit(RANGES)))
    sums = ranged.groupBy("band", "range").agg(F.sum("n_rows").alias("rows"))
    along = Window.partitionBy("band").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("band", "range", F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("band")).alias("whole"))
    within = F.sum("n_rows").over(Window.partitionBy("band", "range").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = stored(
        ranged.withColumn("upto", within).join(offsets, ["band", "range"])
        .select("group_id", "n_rows", "whole", ((F.col("before") + F.col("upto") - F.col("n_rows") / 2) / F.col("whole")).alias("point"), "band"),
        "placed-groups", ("band",),
    )
    bands = {r["band"]: r["rows"] for r in placed.groupBy("band").agg(F.max("whole").alias("rows")).collect()}
    lack = {part: pct / sum(wanted.values()) * sum(bands.values()) for part, pct in sorted(wanted.items())}
    part = F.lit(None).cast("string")
    for band in sorted(bands, reverse=True):
        dealt = _part_at(F.col("point"), _edges(lack))
        part = F.when(F.col("band") == band, dealt).otherwise(part)
        for r in placed.filter(F.col("band") == band).groupBy(dealt.alias("part")).agg(F.sum("n_rows").alias("rows")).collect():
            lack[r["part"]] -= r["rows"]
    return placed.select("group_id", part.alias("split_part"))


def split_records(collection: DataFrame, diagnostics: DataFrame, plan: DataFrame, aliases: DataFrame | None = None, seed: str = "split-1") -> DataFrame:
    """table_name, row_no, group_id, split_part for every row of both tables (record_no of the collection, diag_no of the
    diagnostics).

    A row belongs to the group of its event. A row without a usable event_id belongs to the group of an event with its
    pair of objects, else of an event with its message identifier, else is a group of its own. Events known to
    the diagnostics alone are groups of one event. Repeated rows are each assigned, alike."""
    keyed = keyed_records(collection, aliases)
    members, _ = related_groups(collection, aliases)
    members = cut(members)
    placed = keyed.join(members, "event", "left").withColumn("group_id", F.coalesce("group_id", "event"))
    known = cut(placed.filter("group_id is not null").select("group_id", "pair_key", "message_key", "record_no"))
    of_pair = known.filter("pair_key is not null").groupBy("pair_key").agg(F.min("group_id").alias("by_pair"))
    of_message = known.filter("message_key is not null").groupBy("message_key").agg(F.min("group_id").alias("by_message"))
    lost = (
        keyed.filter("event is null").join(of_pair, "pair_key", "left").join(of_message, "message_key", "left")
        .select("record_no", F.coalesce("by_pair", "by_message", F.concat(F.lit("record:"), F.coalesce(F.col("record_no").cast("string"), F.lit("?")))).alias("group_id"))
    )
    scored = diagnostics.select("diag_no", event_key(F.col("event_id")).alias("event")).join(members, "event", "left")
    scored = scored.select("diag_no", F.coalesce("group_id", "event", F.concat(F.lit("diag:"), F.coalesce(F.col("diag_no").cast("string"), F.lit("?")))).alias("group_id"))
    rows = (
        known.select(F.lit("external_collection").alias("table_name"), F.col("record_no").alias("row_no"), "group_id")
        .unionByName(lost.select(F.lit("external_collection").alias("table_name"), F.col("record_no").alias("row_no"), "group_id"))
        .unionByName(scored.select(F.lit("history_gate_diagnostics").alias("table_name"), F.col("diag_no").alias("row_no"), "group_id"))
    )
    rows = cut(rows)
    parts = assign_parts(rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows")), plan, seed)
    return rows.join(parts, "group_id").select("table_name", "row_no", "group_id", "split_part")
