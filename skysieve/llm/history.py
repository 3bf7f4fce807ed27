"""Deduplicating new batches against all history by a pivot-distance table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.functions.keys import finite_or_null, message_key, with_pair_key
from skysieve.llm.forest import spanning_forest
from skysieve.operators.messages import MESSAGE_FIELDS
from skysieve.session import cut, discard, scratch_path, stored

#: Readings that two reports of one message must agree on where both have them.
READINGS = MESSAGE_FIELDS

#: Scales of the metric: messages at distance 1 are a minute apart in creation or five seconds in closest approach, or
#: differ by a thousandth in a reading.
CREATION_US, TCA_US, READING = 60_000_000, 5_000_000, 1e-3

#: Readings in which the third and fourth pivot lie, besides the two times.
PIVOT_READINGS = {"d_c": ("miss_distance", "relative_speed"), "d_d": ("mahalanobis_distance", "t_position_covariance_det")}

#: How far pivot distances of linked messages may be apart: pivot distances are sums over coordinates in each of which linked messages differ
#: by at most 1 (a little more in the logarithm of a reading). The slack is for rounding and enters the pruning alone.
REACH, REACH_READINGS = 2 + 1e-6, 4.01

#: Width of the ranges of the first two pivot distances on which deliveries and history are joined, and of the bands (about 15 days of closest
#: approach) into which the files of the history are parted.
RANGE, BAND = 32, 1 << 18

#: Deliveries of at most so many records are sent to the tasks that read the history, as 64-bit keys (under 20 MB each); larger ones are joined by a shuffle.
SENT_KEYS = 250_000

#: A delivery that spans more bands than this reads the history without looking at the bands.
MOST_BANDS = 5000

SCHEMAS = {
    "points": "creation_us bigint, low_us bigint, high_us bigint, logs map<string,double>",
    "identifiers": "k1 bigint, k2 bigint, first_no bigint, first_batch int",
    "pivots": "cell bigint, pair_key string, first_no bigint, first_batch int, creation_us bigint, tca_us bigint, readings array<double>, d_a double, d_b double, d_c double, d_d double, h1 bigint, h2 bigint, band int",
    "links": "record_no bigint, collection_batch int, to_no bigint, to_batch int",
}


def _batch_no() -> Column:
    return F.coalesce(F.col("collection_batch").cast("int"), F.lit(0)).alias("collection_batch")


def _logarithm(reading: str) -> str:
    x = f"readings[{READINGS.index(reading)}]"
    return f"CASE WHEN {x} > 0 AND {x} < double('infinity') THEN ln({x}) END"


def true_distance(a: str, b: str) -> Column:
    """The distance of two messages on one pair of objects: the greatest of their scaled differences in creation, closest
    approach and each reading present in both. As a missing reading agrees with any, this is no metric by itself; on the times, and on
    readings that both have, it is one, and pivot distances are taken on these only."""
    apart = f"CASE WHEN p IS NULL OR q IS NULL OR p = q THEN 0D ELSE abs(p - q) / ({READING}D * greatest(abs(p), abs(q))) END"
    times = f"abs({a}.creation_us - {b}.creation_us) / {CREATION_US}, abs({a}.tca_us - {b}.tca_us) / {TCA_US}"
    return F.expr(f"greatest({times}, array_max(zip_with({a}.readings, {b}.readings, (p, q) -> {apart})))")


def _within_reach(a: str, b: str) -> Column:
    """What the triangle inequality demands of the pivot distances of linked messages."""
    times = [f"abs({a}.{d} - {b}.{d}) <= {REACH}D" for d in ("d_a", "d_b")]
    readings = [f"coalesce(abs({a}.{d} - {b}.{d}) <= {REACH_READINGS}D, true)" for d in PIVOT_READINGS]
    return F.expr(" AND ".join(times + readings))


def _cell(a: str, b: str) -> Column:
    """The cell of a pair of objects and of ranges of the first two pivot distances."""
    return F.expr(f"xxhash64(pair_key, bigint(floor({a} / {RANGE})), bigint(floor({b} / {RANGE})))")


def _reach(counts: list) -> tuple[list[int] | None, bool]:
    """The bands that a delivery touches, None where they are too many to name, and whether its keys are few enough to be sent; from rows of band and
    count."""
    bands = sorted({c["band"] for c in counts}) if len(counts) <= MOST_BANDS else None
    return bands, bands is not None and sum(c["count"] for c in counts) <= SENT_KEYS


#: What a content carries through the comparison.
BODY = ("pair_key", "first_no", "first_batch", "creation_us", "tca_us", "d_a", "d_b", "d_c", "d_d", "readings")


def _bands(rows: DataFrame, *keep: str) -> DataFrame:
    """band: the bands of the history that each row touches, -1 for rows without a content."""
    at = ", ".join(f"int(floor((d_a + {x}D) / {BAND}))" for x in (-REACH, 0, REACH))
    return rows.select(*keep, F.expr(f"explode(CASE WHEN d_a IS NULL THEN array(-1) ELSE array_distinct(array({at})) END)").alias("band"))


def _near_links(members: DataFrame) -> DataFrame:
    """Links between contents within distance 1 of each other, as far as they are needed to connect them, from contents in cells (cell, fresh, BODY).

    Every content is measured against the first one of its cell; those within distance 1 of it are connected by that, so only the
    rest are measured against all contents of the cell. A cell crowded with thousands of noisy copies of one message
    thus takes one comparison each. At least one of two linked contents is fresh; cells with one content, or without a fresh one, are done."""
    first = F.min(F.struct("first_no", *(c for c in BODY if c != "first_no"))).alias("l")
    crowded = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bool_or("fresh").alias("any"), first).filter("n > 1 and any").select("cell", "l")
    tested = members.select("cell", "fresh", F.struct(*BODY).alias("x")).join(crowded, "cell")
    tested = tested.withColumn("by_leader", (F.col("x.pair_key") == F.col("l.pair_key")) & _within_reach("x", "l") & (true_distance("x", "l") <= 1))
    to_leader = tested.filter("by_leader and fresh and x.first_no <> l.first_no").select("x.first_no", "x.first_batch", F.col("l.first_no").alias("to_no"), F.col("l.first_batch").alias("to_batch"))
    a, b = tested.filter("not by_leader").select("cell", F.col("fresh").alias("a_fresh"), F.col("x").alias("a")), tested.select("cell", F.col("fresh").alias("b_fresh"), "by_leader", F.col("x").alias("b"))
    order = F.col("b.first_no") < F.col("a.first_no")
    pairs = a.join(b, "cell").filter((F.col("a.pair_key") == F.col("b.pair_key")) & (F.col("a.first_no") != F.col("b.first_no")) & (order | F.col("by_leader")) & (F.col("a_fresh") | F.col("b_fresh")) & _within_reach("a", "b")).filter(true_distance("a", "b") <= 1)
    later = lambda x, y: F.when(order, F.col(x)).otherwise(F.col(y))
    among = pairs.select(later("a.first_no", "b.first_no"), later("a.first_batch", "b.first_batch"), later("b.first_no", "a.first_no"), later("b.first_batch", "a.first_batch"))
    return to_leader.union(among).toDF("record_no", "collection_batch", "to_no", "to_batch")


def _together(*steps: Callable[[], object]) -> None:
    """Run steps that do not wait for each other as concurrent jobs; the first failure is raised."""
    failed: list[BaseException] = []

    def run(step: Callable[[], object]) -> None:
        try:
            step()
        except BaseException as error:  # noqa: BLE001
            failed.append(error)

    threads = [InheritableThread(target=run, args=(step,)) for step in steps]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]


class MessageHistory:
    """All messages accepted so far, in tables that only grow: identifiers (first record of each usable identifier, by a 128-bit hash), pivots
    (one row per distinct content of an identified pair: its first record and its distances to four fixed pivots) and links (record that
    repeats another). The pivots (points) are taken from the first delivery that has any content and stay fixed: early creation with early and
    with late closest approach, and both of these again with the medians of two readings each.

    `accept` compares a delivery of one or more batches with itself and with the history, and appends what is new. By the triangle
    inequality, linked messages differ by at most 2 in their distance to the first and to the second pivot, so both are joined on ranges of these
    distances; the distances to the other two prune further where the readings are there, and the true distance decides. The history lies in
    folders by band of the first distance and in files by range of it: of these the delivery reads only the bands that its own messages
    touch, so one misdated message opens one band more. Of the identifiers all keys are read, as any may come again, but only the delivery's go
    on. Exact copies are collapsed before the join, so a message with a third of all records meets the join as one row.

    Records with neither a usable identifier nor an identified pair, creation and closest approach repeat nothing. Times that
    cannot be read count as missing; null and NaN readings are missing; batch null counts as the first. Repeated rows of one
    record_no are one record. Columns that are not named here are not read."""

    def __init__(self, spark: SparkSession, path: str | None = None, aliases: DataFrame | None = None) -> None:
        self.spark, self.aliases = spark, aliases
        self.path = path or scratch_path(spark, "message-history")
        for name, schema in SCHEMAS.items():
            if not self._exists(name):
                empty = spark.createDataFrame([], schema).coalesce(1)
                empty.write.mode("append").partitionBy(*(["band"] if name == "pivots" else [])).parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*(f.name for f in self.read(name).schema)).write.mode("append").partitionBy(*(["band"] if name == "pivots" else [])).parquet(f"{self.path}/{name}")

    def keyed(self, records: DataFrame) -> DataFrame:
        """record_no, batch, two hashes k1, k2 of the identifier (null where unusable), and of records of identified pairs whose times can be
        read: pair_key, times, readings and two hashes h1, h2 of all that."""
        micros = lambda c: F.unix_micros(F.try_to_timestamp(F.col(c).cast("string")))
        rows = with_pair_key(records, self.aliases).filter(F.col("record_no").isNotNull()).select(
            "record_no", _batch_no(), message_key(F.col("source_message_id")).alias("k"), "pair_key", micros("creation_date").alias("creation_us"), micros("tca").alias("tca_us"),
            F.array(*(finite_or_null(F.col(r)) for r in READINGS)).alias("readings"),
        )
        found = F.col("pair_key").isNotNull() & F.col("creation_us").isNotNull() & F.col("tca_us").isNotNull()
        content = ("pair_key", "creation_us", "tca_us", "readings")
        twice = lambda when, *of: (F.when(when, F.xxhash64(*of)), F.when(when, F.xxhash64(F.lit(17), *of)))
        (k1, k2), (h1, h2) = twice(F.col("k").isNotNull(), "k"), twice(found, *content)
        return rows.select("record_no", "collection_batch", k1.alias("k1"), k2.alias("k2"), *(F.when(found, F.col(c)).alias(c) for c in content), h1.alias("h1"), h2.alias("h2"))

    def _points(self, rows: DataFrame) -> dict:
        """The fixed pivots; from `rows` where there are none yet."""
        known = self.read("points").first()
        if known is not None:
            return known.asDict()
        names = sorted({r for pair in PIVOT_READINGS.values() for r in pair})
        seen = rows.filter("h1 is not null").agg(
            F.percentile_approx("creation_us", 0.01).alias("creation_us"), F.percentile_approx("tca_us", 0.01).alias("low_us"), F.percentile_approx("tca_us", 0.99).alias("high_us"),
            *(F.percentile_approx(F.expr(_logarithm(r)), 0.5).alias(r) for r in names),
        ).first()
        points = {k: seen[k] or 0 for k in ("creation_us", "low_us", "high_us")} | {"logs": {r: seen[r] or 0.0 for r in names}}
        if seen["creation_us"] is not None:
            self._append("points", self.spark.createDataFrame([points], SCHEMAS["points"]))
        return points

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Add the distances to the pivots (sums of scaled differences; null where a reading is missing) and the band."""
        p = self._points(rows)
        early, late = (f"abs(creation_us - {p['creation_us']}) / {CREATION_US} + abs(tca_us - {p[end]}) / {TCA_US}" for end in ("low_us", "high_us"))
        apart = {d: " + ".join(f"abs({_logarithm(r)} - {p['logs'][r]!r}D) / {READING}D" for r in names) for d, names in PIVOT_READINGS.items()}
        return (
            rows.selectExpr("*", f"{early} AS d_a", f"{late} AS d_b")
            .selectExpr("*", f"d_a + {apart['d_c']} AS d_c", f"d_b + {apart['d_d']} AS d_d", f"int(floor(d_a / {BAND})) AS band")
        )

    def accept(self, batch: DataFrame) -> None:
        """Find what the records of a delivery repeat, among themselves and in the history, and add them to the history."""
        rows = self._placed(stored(self.keyed(batch), "delivery"))
        self._accept(rows, *_reach(_bands(rows).groupBy("band").count().limit(MOST_BANDS + 1).collect()))

    def accept_batches(self, records: DataFrame, deliveries: int | None = None) -> None:
        """Accept the batches of `records` in turn, each as a delivery of its own, or consecutive ones together in so many deliveries of about as
        many records each. The results are the same; a delivery costs a few dozen small jobs whatever its size."""
        keyed = stored(self.keyed(records), "deliveries", ("collection_batch",))
        sizes = keyed.groupBy("collection_batch").count().orderBy("collection_batch").collect()
        groups: list[list[int]] = []
        total, passed = sum(r["count"] for r in sizes), 0
        for r in sizes:
            if not groups or deliveries is None or passed * deliveries >= total * len(groups):
                groups.append([])
            groups[-1].append(r["collection_batch"])
            passed += r["count"]
        if groups:
            self._points(keyed.filter(F.col("collection_batch").isin(groups[0])))
            rows = self._placed(keyed)
            most = (MOST_BANDS + 1) * len(sizes)
            counts = _bands(rows, "collection_batch").groupBy("collection_batch", "band").count().limit(most).collect()
            for group in groups:
                own = [c for c in counts if c["collection_batch"] in group]
                self._accept(rows.filter(F.col("collection_batch").isin(group)), *(_reach(own) if len(counts) < most else (None, False)))

    def _tidy(self) -> None:
        """Let Spark delete the shuffle files and sent keys of what is done: they go once the driver has collected what named them."""
        self.spark._jvm.System.gc()

    def _accept(self, rows: DataFrame, bands: list[int] | None, small: bool) -> None:
        """Append the identifiers and contents of a delivery that the history lacks, and its links to itself and to the history as it was before."""
        sent = F.broadcast if small else lambda df: df
        history = self.read("pivots") if bands is None else self.read("pivots").filter(F.col("band").isin(bands))
        found: dict[str, DataFrame] = {}
        paths = {name: scratch_path(self.spark, f"delivery-{name}") for name in ("contents", "identifiers")}

        def compare_contents() -> None:
            contents = found["contents"] = stored(self._contents(rows), "contents", path=paths["contents"])
            known = history.select("h1", "h2").join(sent(contents.select("h1")), "h1", "left_semi")
            fresh = contents.join(sent(known), ["h1", "h2"], "left_anti").withColumn("cell", _cell("d_a", "d_b"))
            self._append("pivots", fresh.sortWithinPartitions("band", "d_a") if small else fresh.repartitionByRange("band", "d_a"))

        def compare_identifiers() -> None:
            identifiers = found["identifiers"] = stored(self._identifiers(rows, sent), "identifiers", path=paths["identifiers"])
            self._append("identifiers", identifiers.filter("known_no is null"))

        _together(compare_contents, compare_identifiers)
        self._tidy()
        links = self._identifier_links(rows, found["identifiers"], sent).unionByName(self._copy_links(rows, found["contents"], sent))
        links = links.unionByName(_near_links(self._members(found["contents"], history, sent)))
        self._append("links", links.filter("record_no <> to_no"))
        for path in paths.values():
            discard(self.spark, path)
        self._tidy()

    def _identifiers(self, rows: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The delivery's identifiers: first and last record in it, and first record in the history."""
        keys = ["k1", "k2"]
        new = rows.filter("k1 is not null").groupBy(*keys).agg(F.min("record_no").alias("first_no"), F.min("collection_batch").alias("first_batch"), F.max("record_no").alias("last_no"))
        # One of the two hashes is sent to the tasks that read the history; the join then tells apart what agrees in it alone.
        met = self.read("identifiers").join(sent(rows.filter("k1 is not null").select("k1")), "k1", "left_semi").select(*keys, F.col("first_no").alias("known_no"), F.col("first_batch").alias("known_batch"))
        return new.join(met, keys, "left")

    def _contents(self, rows: DataFrame) -> DataFrame:
        """The delivery's distinct contents with first and last record; copies are counted in map tasks first."""
        return (
            rows.filter("h1 is not null").groupBy("h1", "h2", *(c for c in BODY if c not in ("first_no", "first_batch")), "band")
            .agg(F.min("record_no").alias("first_no"), F.min("collection_batch").alias("first_batch"), F.max("record_no").alias("last_no"))
        )

    def _members(self, contents: DataFrame, history: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The contents of the delivery in every cell that they may share with a linked one, and those of the history in their own, where the delivery
        has any."""
        cells = [_cell(f"(d_a + {x}D)", f"(d_b + {y}D)") for x in (-REACH, REACH) for y in (-REACH, REACH)]
        fresh = contents.withColumn("cell", F.explode(F.array_distinct(F.array(*cells)))).select("cell", *BODY)
        met = history.select("cell", *BODY).join(sent(fresh.select("cell")), "cell", "left_semi")
        return fresh.withColumn("fresh", F.lit(True)).unionByName(met.withColumn("fresh", F.lit(False)))

    def _identifier_links(self, rows: DataFrame, identifiers: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
        target = identifiers.filter("known_no is not null or last_no <> first_no").select("k1", "k2", F.coalesce("known_no", "first_no").alias("to_no"), F.coalesce("known_batch", "first_batch").alias("to_batch"))
        return rows.filter("k1 is not null").select("record_no", "collection_batch", "k1", "k2").join(sent(target), ["k1", "k2"]).drop("k1", "k2")

    def _copy_links(self, rows: DataFrame, contents: DataFrame, sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """To the first record of the same content in the delivery."""
        target = contents.filter("last_no <> first_no").select("h1", "h2", F.col("first_no").alias("to_no"), F.col("first_batch").alias("to_batch"))
        return rows.filter("h1 is not null").select("record_no", "collection_batch", "h1", "h2").join(sent(target), ["h1", "h2"]).drop("h1", "h2")

    def repeats(self) -> DataFrame:
        """first_record_no, repeat_record_no: every record whose message first came in an earlier batch, with the lowest
        record_no of that message. Repetition carries over from record to record; as a later record may join two messages,
        the closure is taken over the links, which only records with a repeat have."""
        links = self.read("links")
        _, members = spanning_forest(links, "record_no", "to_no")
        batches = links.select("record_no", "collection_batch").unionByName(links.select(F.col("to_no").alias("record_no"), F.col("to_batch").alias("collection_batch"))).distinct()
        placed = cut(members.join(batches.groupBy("record_no").agg(F.min("collection_batch").alias("collection_batch")), F.col("node") == F.col("record_no")).select("record_no", "collection_batch", "root"))
        first = placed.groupBy("root").agg(F.min("record_no").alias("first_record_no"), F.min("collection_batch").alias("first_batch"))
        return (
            placed.join(first, "root").filter("collection_batch > first_batch")
            .select("first_record_no", F.col("record_no").alias("repeat_record_no"))
        )


def repeated_messages(collection: DataFrame, aliases: DataFrame | None = None, path: str | None = None, deliveries: int | None = 3) -> DataFrame:
    """The repeats of a whole collection: its batches are accepted in turn, consecutive ones together in so many deliveries (None: each batch by
    itself), so that each batch is compared with itself and all earlier ones."""
    history = MessageHistory(collection.sparkSession, path, aliases)
    history.accept_batches(collection, deliveries)
    return history.repeats()
