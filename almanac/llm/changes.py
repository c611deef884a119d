"""Sequenced change applier: out-of-order change rows applied per client by number.

A stateful streaming query holds each client's rows until their turn comes, as
an LSM tree does: every batch appends what it cannot apply yet as one run
sorted by number to a ListState, with cursors per run in a ValueState. Rows
are taken from the runs by a k-way heap merge: the next number as soon as it
is held, and all up to the last expired number when time runs out. After
``RUNS`` runs what is left of them is merged into one.

A client may have any share of all rows, so its numbers are cut into segments
of ``SEGMENT``. Segments are dealt by hash to state keys of about ``BUCKET``,
whose number follows the data; a run is sorted by segment, then number, and
each segment has its own cursors. A segment knows by itself which of its
rows have expired. What it cannot know, how far the client has come in other
segments, is worked out between two batches from the summaries that segments
emit (how far they are contiguous, which number expired last) by aggregates per
client, and is fed to the segments concerned as control rows of the next batch.
Rows that drain on such news are marked with the batch where it happened. The
same rows wake segments that hold rows and get none. Values are folded inside a
segment; where a segment has not set a value yet, it comes from the client's
earlier segments by a prefix scan over segments (:func:`before`), which never
sorts more than 64 rows of a client at once. So does the dense rank that numbers
the rows. Of rows that share client, number and batch only the first can be
held; if many share them, the others go to keys of their own, to be rejected.

Between batches only eight days (one per batch) go to the driver.

Edge cases: rows equal in all columns count once; a null client_id is a client
of its own; a null seq counts as the largest one; an unknown or null op changes
nothing but takes its number; days before the first batch belong to it; rows
that share day and change_id come in order of seq, op, city and balance; a batch without
rows still lets rows expire; an empty table gives no rows; a column that clashes
with a name used here is only part of what makes a row distinct.
"""

from __future__ import annotations

import contextlib
import heapq
import pickle
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from almanac.llm.common import cut, delete, shared_folder, table

BATCHES = 8
#: First day and length in days of the span that is cut into batches.
FIRST_DAY, SPAN = 19723, 160
#: A held row expires when another client's rows are this many days ahead.
PATIENCE = 5
#: Numbers of a client per segment, and segments per state key.
SEGMENT, BUCKET = 64, 32
#: Runs of a key beyond which they are merged into one.
RUNS = 4
#: Rows of one client, number and batch that may go to one key.
REPEATS = 4
KEY = ["nameless", "client"]
#: A start runs one batch, so each store is closed as it commits; without that, every start would leave one open per partition.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

INPUT = "nameless boolean, client long, segment long, salt int, at int, n long, day int, change_id long, op string, city string, balance double, seen int, ahead int, reached long, least long, last boolean, bucket long"
OUTPUT = (
    "kind string, nameless boolean, client long, segment long, n long, change_id long, status string, at int, prev long, op string, "
    "city string, city_set boolean, balance double, balance_set boolean, held int, entered boolean, next long, gap long, expired long, after long"
)
OUT = [part.split()[0] for part in OUTPUT.split(", ")]


def before(rows: DataFrame, key: list[str], at: str, folds: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``rows`` with each column of ``folds`` replaced by its fold (``F.sum`` or ``F.max``) over the key's rows of smaller ``at``; null if there are none.

    ``at`` is unique within a key. Blocks of 64 are scanned by a window each,
    and their totals the same way, level by level.
    """
    low, high = rows.agg(F.min(at), F.max(at)).first()
    own = {name: f"_own_{name}" for name in folds}

    def within(*group: str) -> DataFrame:
        w = Window.partitionBy(*key, *group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({own[name]: f(F.col(name)).over(w) for name, f in folds.items()})

    if low is None or high - low < 64:
        return within().drop(*folds).withColumnsRenamed({v: k for k, v in own.items()})
    up = f"{at}_up"
    rows = rows.withColumn(up, F.shiftright(at, 6))
    totals = rows.groupBy(*key, up).agg(*(f(F.col(name)).alias(name) for name, f in folds.items()))
    carried = before(totals, key, up, folds)
    both = within(up).drop(*folds).join(carried, [*key, up]).drop(up)
    for name, f in folds.items():
        joined = F.coalesce(F.col(own[name]) + F.col(name), F.col(own[name]), F.col(name)) if f is F.sum else F.greatest(F.col(own[name]), F.col(name))
        both = both.withColumn(name, joined)
    return both.drop(*own.values())


def numbered(changes: DataFrame, batches: int, first_day: int, span: int) -> DataFrame:
    """The distinct rows that take part, with their number ``n``, day, batch, segment and salt."""
    h = F.crc32(F.coalesce(F.col("change_id").cast("string"), F.lit("")).cast("binary"))
    day = F.unix_date(F.to_date("valid_at")) + 2 * (h % 4).cast("int")
    at = F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((F.col("day") - first_day) * batches / span))).cast("int")
    rows = changes.distinct().select(
        F.col("client_id").isNull().alias("nameless"), F.coalesce(F.col("client_id").cast("long"), F.lit(0)).alias("client"), F.coalesce(F.col("seq").cast("long"), F.lit(2**63 - 1)).alias("seq"),
        F.col("change_id").cast("long").alias("change_id"), "op", "city", F.col("balance").cast("double").alias("balance"), day.alias("day"), (h % 11 == 0).alias("gone"),
    )
    rows = cut(rows.withColumn("at", F.when(F.col("day").isNotNull() & ~F.col("gone"), at)).drop("gone"))
    told = cut(rows.groupBy(*KEY, "seq", "at").agg(F.min(F.struct("day", "change_id")).alias("first"), F.count("*").alias("rows")))
    ranks = told.select(*KEY, "seq").distinct().withColumn("block", F.shiftright("seq", 6))
    carried = before(ranks.groupBy(*KEY, "block").agg(F.count("*").alias("n")), KEY, "block", {"n": F.sum}).withColumnRenamed("n", "earlier")
    local = F.row_number().over(Window.partitionBy(*KEY, "block").orderBy("seq"))
    ranks = ranks.withColumn("local", local).join(carried, [*KEY, "block"]).select(*KEY, "seq", (F.coalesce("earlier", F.lit(0)) + F.col("local")).alias("n"))
    told = told.where("at IS NOT NULL").join(ranks, [*KEY, "seq"])
    later = (F.col("rows") > REPEATS) & (F.struct("day", "change_id") != F.col("first"))
    salt = F.when(later, 1 + F.pmod(F.xxhash64("change_id"), F.ceil(F.col("rows") / REPEATS))).otherwise(0).cast("int")
    placed = rows.join(told, [*KEY, "seq", "at"]).withColumn("salt", salt).withColumn("segment", F.floor((F.col("n") - 1) / SEGMENT).cast("long"))
    return placed.drop("seq", "first", "rows")


class Turn:
    """One segment of one client while a batch is handled."""

    def __init__(self, own: tuple, head: tuple | None, slices: list[list]):
        self.nameless, self.client, self.segment = own
        self.low, self.high = self.segment * SEGMENT + 1, (self.segment + 1) * SEGMENT
        # The next number here, whether the client has come here, the last number applied here, and the values that are set here.
        self.at, self.entered, self.prev, self.city, self.city_set, self.balance, self.balance_set = head or (self.low, self.segment == 0, 0, None, False, None, False)
        #: Of each run that holds rows of the segment: [run, cursor, end, rows].
        self.slices = slices
        self.heap = [(rows[c][3], k) for k, (_, c, _, rows) in enumerate(slices)]
        heapq.heapify(self.heap)
        self.out: list[Row] = []

    def head(self) -> tuple:
        return self.at, self.entered, self.prev, self.city, self.city_set, self.balance, self.balance_set

    def held(self) -> list[tuple]:
        return [row for _, c, end, rows in self.slices for row in rows[c:end]]

    def row(self, **values) -> Row:
        return Row(**dict.fromkeys(OUT) | {"nameless": self.nameless, "client": self.client, "segment": self.segment} | values)

    def reject(self, n: int, change_id: int | None, op: str | None, label: int) -> None:
        self.out.append(self.row(kind="row", status="rejected", n=n, change_id=change_id, op=op, at=label))

    def drain(self, upto: int, label: int) -> None:
        """Apply held rows: those up to ``upto`` whatever is missing, then what is contiguous if the client has come here."""
        heap = self.heap
        while heap and (heap[0][0] <= upto or self.entered and heap[0][0] == self.at):
            n, k = heapq.heappop(heap)
            piece = self.slices[k]
            _, cursor, end, rows = piece
            change_id, op, city, balance = rows[cursor][5:]
            piece[1] = cursor + 1
            if cursor + 1 < end:
                heapq.heappush(heap, (rows[cursor + 1][3], k))
            if op == "D":
                self.city, self.balance, self.city_set, self.balance_set = None, None, True, True
            else:
                if op == "I" or op == "U" and city is not None:
                    self.city, self.city_set = city, True
                if op == "I" or op == "U" and balance is not None:
                    self.balance, self.balance_set = balance, True
            self.out.append(self.row(kind="row", status="applied", n=n, change_id=change_id, at=label, prev=self.prev, op=op, city=self.city, city_set=self.city_set, balance=self.balance, balance_set=self.balance_set))
            self.at, self.prev, self.entered = n + 1, n, True

    def come(self, number: int | None, label: int) -> None:
        """The client's next number is ``number``, or beyond."""
        if number is not None and number >= self.low:
            self.drain(number - 1, label)
            self.at, self.entered = max(self.at, min(number, self.high + 1)), True

    def hear(self, at: int, seen: int | None, reached: int | None, least: int | None, last: bool) -> None:
        """What a control row says: how far the client had come, how far it jumps, and which held rows have expired."""
        self.come(reached, at - 1)
        self.come(least, at)
        if last:
            self.drain(self.high, at)
        elif seen is not None:
            self.drain(max((row[3] for row in self.held() if row[4] + PATIENCE <= seen), default=0), at)

    def read(self, rows: list[tuple], label: int) -> list[tuple]:
        """Reject what is too late or there already; the others, by number. They may be applied after the batch is read: until then only numbers that have come pass."""
        held = {row[3] for row in self.held()}
        fresh = []
        for row in sorted(rows, key=lambda r: (r[4], -1 if r[5] is None else r[5], r[3], r[6] or "", r[7] or "", r[8] or 0.0)):
            if row[3] < self.at or row[3] in held:
                self.reject(row[3], row[5], row[6], label)
            else:
                held.add(row[3])
                fresh.append(row)
        return sorted(fresh, key=lambda row: row[3])

    def gap(self, waiting: dict[int, int], n: int) -> int | None:
        """The first number of the segment from ``n`` that does not wait; none if all do."""
        while n in waiting:
            n += 1
        return n if n <= self.high else None

    def summary(self, label: int, ahead: int | None) -> Row:
        waiting = {row[3]: row[4] for row in self.held()}
        expired = max((n for n, day in waiting.items() if ahead is not None and day + PATIENCE <= ahead), default=None)
        after = None if expired is None else self.gap(waiting, expired + 1)
        return self.row(kind="summary", at=label, held=len(waiting), entered=self.entered, next=self.at, gap=self.gap(waiting, self.at), expired=expired, after=after)


class Applier(StatefulProcessor):
    """The segments of one bucket; see the module for what their control rows say.

    State: ``runs``, a ListState of runs, each sorted by segment and number and
    never changed once it is written; ``heads``, where each segment has come and
    its cursors, (run, cursor, end). A row of a run is (nameless, client,
    segment, n, day, change_id, op, city, balance).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.heads = handle.getValueState("heads", "heads binary")
        self.runs = handle.getListState("runs", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        news: dict[tuple, tuple] = {}
        data: dict[tuple, list[tuple]] = {}
        stray = []
        label = ahead = None
        for nameless, client, segment, salt, at, n, day, change_id, op, city, balance, seen, soon, reached, least, last, _ in rows:
            own = nameless, client, segment
            if salt:  # the first row of each number is held, applied or rejected elsewhere
                stray.append((own, n, change_id, op, at))
            elif day is None:
                news[own], label, ahead = max(news.get(own, (0,)), (at, seen, reached, least, last)), at, soon
            else:
                data.setdefault(own, []).append((*own, n, day, change_id, op, city, balance))
                label, ahead = at, soon
        for own, n, change_id, op, at in stray:
            turn = Turn(own, None, [])
            turn.reject(n, change_id, op, at)
            yield from turn.out
        if label is None:
            return
        stored = self.heads.get()
        count, heads = pickle.loads(stored[0]) if stored else (0, {})
        runs = [pickle.loads(run[0]) for run in self.runs.get()] if count else []
        fresh: list[tuple] = []
        for own in sorted({*news, *data}):
            head, cursors = heads.get(own, (None, []))
            turn = Turn(own, head, [[k, c, end, runs[k]] for k, c, end in cursors])
            had = bool(turn.slices)
            if own in news:
                turn.hear(*news[own])
            new = turn.read(data.get(own, []), label)
            if new:
                turn.slices.append([len(runs), 0, len(new), new])
                heapq.heappush(turn.heap, (new[0][3], len(turn.slices) - 1))
                turn.drain(0, label)
            yield from turn.out
            left = [piece for piece in turn.slices if piece[1] < piece[2]]
            if left and left[-1][3] is new:
                left[-1][1:3] = [len(fresh), len(fresh) + len(new) - left[-1][1]]
                fresh += new[-(left[-1][2] - left[-1][1]) :]
            heads[own] = turn.head(), [(k, c, end) for k, c, end, _ in left]
            if had or left or turn.segment or turn.at > turn.high:
                turn.slices = [[k, c, end, fresh if k == len(runs) else rows] for k, c, end, rows in left]
                yield turn.summary(label, ahead)
        if fresh:
            self.runs.appendValue((pickle.dumps(fresh),))
            runs.append(fresh)
        if len(runs) > RUNS or not any(cursors for _, cursors in heads.values()):
            self.merge(runs, heads)
            count = min(1, sum(len(cursors) for _, cursors in heads.values()))
        else:
            count = len(runs)
        self.heads.update((pickle.dumps((count, heads)),))

    def merge(self, runs: list[list[tuple]], heads: dict[tuple, tuple]) -> None:
        """Merge what is left of all runs into one, and set the cursors to it."""
        whole: list[tuple] = []
        for own in sorted(heads):
            head, cursors = heads[own]
            if cursors:
                start = len(whole)
                whole += heapq.merge(*(runs[k][c:end] for k, c, end in cursors), key=lambda row: row[3])
                heads[own] = head, [(0, start, len(whole))]
        if whole:
            self.runs.put([(pickle.dumps(whole),)])
        elif runs:
            self.runs.clear()

    def close(self) -> None:
        pass


def progress(latest: DataFrame) -> DataFrame:
    """(key, reached, least) of the clients with more than one segment: their next number now, and after what has expired.

    The first gap at or after a place is the least gap of the segments from
    there on; a segment that no row has reached begins with one.
    """
    several = latest.where("segment >= 1").select(*KEY).distinct()
    own = latest.join(several, KEY)
    absent = own.select(*KEY, (F.col("segment") + 1).alias("segment"), ((F.col("segment") + 1) * SEGMENT + 1).alias("start")).join(own.select(*KEY, "segment"), [*KEY, "segment"], "left_anti")
    gaps = own.where("gap IS NOT NULL").select(*KEY, "segment", "gap").unionByName(absent.select(*KEY, "segment", F.col("start").alias("gap")))
    ends = own.groupBy(*KEY).agg(F.max(F.when(F.col("entered"), F.col("segment"))).alias("here"), F.max(F.when(F.col("expired").isNotNull(), F.struct("expired", "segment", "after"))).alias("old"))
    reached = F.min(F.when(F.col("segment") >= F.col("here"), F.col("gap"))).alias("reached")
    beyond = F.min(F.when(F.col("segment") > F.col("old.segment"), F.col("gap"))).alias("beyond")
    both = gaps.join(ends, KEY).groupBy(*KEY, "old").agg(reached, beyond)
    jumped = F.when(F.col("old.expired") >= F.coalesce("reached", F.lit(0)), F.coalesce("old.after", "beyond"))
    return both.select(*KEY, "reached", jumped.alias("least"))


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder in whatever store it is; nothing if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(source)):
        files.mkdirs(path(target).getParent())
        if not files.rename(path(source), path(target)):
            raise OSError(f"cannot move {source} to {target}")


def run_batches(spark: SparkSession, rows: DataFrame, folder: str, batches: int) -> DataFrame:
    """What the stateful query emits over all batches, each a start of the query on one checkpoint."""
    segments = rows.agg(F.approx_count_distinct(F.struct(*KEY, "segment"))).first()[0]
    buckets = segments // BUCKET + 1
    days = {r["at"]: r["day"] for r in rows.groupBy("at").agg(F.max("day").alias("day")).collect()}
    seen = {b: max((d for a, d in days.items() if a < b), default=None) for b in range(1, batches + 3)}

    bucket = F.pmod(F.xxhash64(*KEY, "segment", "salt"), F.lit(buckets))

    def told(rows: DataFrame, at: int) -> DataFrame:
        """Rows of batch ``at`` with the largest day before it and up to its end."""
        return rows.withColumn("salt", F.lit(0)).withColumns({"bucket": bucket, "seen": F.lit(seen[at]).cast("int"), "ahead": F.lit(seen[at + 1]).cast("int"), "last": F.lit(at > batches)})

    columns = [part.split()[0] for part in INPUT.split(", ")]
    ahead = F.create_map(*(F.lit(x).cast("int") for b in range(1, batches + 1) for x in (b, seen[b + 1])))
    data = rows.withColumns({"bucket": bucket, "ahead": ahead[F.col("at")], "seen": F.lit(None), "reached": F.lit(None), "least": F.lit(None), "last": F.lit(False)})
    typed = [F.col(name).cast(kind).alias(name) for name, kind in (part.split() for part in INPUT.split(", "))]
    data.select(*typed, F.col("at").alias("batch")).write.partitionBy("batch").parquet(f"{folder}/batches")
    feed, out, latest = f"{folder}/feed", f"{folder}/out", None
    spark.createDataFrame([], INPUT).write.parquet(f"{feed}/start")
    for at in range(1, batches + 2):
        move(spark, f"{folder}/batches/batch={at}", f"{feed}/data-{at}")
        if latest is not None:
            news = latest.where(F.col("held") > 0).where(F.col("at") == at - 1).select(*KEY, "segment")
            if at <= batches and at in days:
                own = spark.read.schema(INPUT).parquet(f"{feed}/data-{at}").where("salt = 0").select(*KEY, "segment").distinct()
                news = news.unionByName(own.join(latest.where("segment >= 1").select(*KEY).distinct(), KEY)).distinct()
            control = told(news.join(progress(latest), KEY, "left").withColumn("at", F.lit(at)), at)
            for name in columns:
                if name not in control.columns:
                    control = control.withColumn(name, F.lit(None))
            control.select(*typed).write.parquet(f"{feed}/control-{at}")
        stream = spark.readStream.schema(INPUT).parquet(f"{feed}/*")
        applied = stream.groupBy("bucket").transformWithState(Applier(), OUTPUT, "Append", "None")
        query = applied.writeStream.format("parquet").partitionBy("kind", "at").option("checkpointLocation", f"{folder}/state").option("path", out).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        if at <= batches:
            found = spark.read.schema(OUTPUT).parquet(out).where(F.col("kind") == "summary")
            new = found.where(F.col("at") == at).select(*KEY, "segment", "at", "held", "entered", "next", "gap", "expired", "after")
            # Only clients with several segments need what a segment said some batches ago.
            kept = new if latest is None else new.unionByName(latest.join(new.select(*KEY, "segment"), [*KEY, "segment"], "left_anti"))
            kept.write.parquet(f"{folder}/latest-{at}")
            latest = spark.read.parquet(f"{folder}/latest-{at}")
            if at > 1:
                delete(spark, f"{folder}/latest-{at - 1}")
    return spark.read.schema(OUTPUT).parquet(out).where(F.col("kind") == "row").drop("kind")


def apply_changes(changes: DataFrame, *, batches: int = BATCHES, first_day: int = FIRST_DAY, span: int = SPAN) -> DataFrame:
    """(change_id, client_id, n, op, status, batch, missed, city, balance, current) of every distinct row of ``changes`` that takes part.

    ``changes`` has change_id, client_id, seq, op, valid_at, city and balance.
    """
    spark = changes.sparkSession
    folder = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    rows = cut(numbered(changes, batches, first_day, span))
    with settings(spark, **STATE):
        out = run_batches(spark, rows, folder, batches)
    for part in ("batches", "feed", "state", f"latest-{batches}"):
        delete(spark, f"{folder}/{part}")
    # What a segment had set when it ended holds in later ones until they set it.
    applied = out.where("status = 'applied'")
    segments = applied.groupBy(*KEY, "segment").agg(
        F.max("n").alias("before_n"),
        F.max(F.when(F.col("city_set"), F.struct("n", "city"))).alias("before_city"), F.max(F.when(F.col("balance_set"), F.struct("n", "balance"))).alias("before_balance"),
        (-F.col("segment")).alias("back"), F.lit(True).alias("later"),
    )
    segments = cut(segments)
    earlier = before(segments.drop("back", "later"), KEY, "segment", {"before_n": F.max, "before_city": F.max, "before_balance": F.max})
    later = before(segments.select(*KEY, "back", "later"), KEY, "back", {"later": F.max}).select(*KEY, (-F.col("back")).alias("segment"), "later")
    ends = segments.select(*KEY, "segment", F.col("before_n").alias("last_n"))
    around = earlier.join(later, [*KEY, "segment"]).join(ends, [*KEY, "segment"])
    is_applied = F.col("status") == "applied"
    previous = F.greatest(F.col("prev"), F.coalesce("before_n", F.lit(0)))
    city = F.when(F.col("city_set"), F.col("city")).otherwise(F.col("before_city.city"))
    balance = F.when(F.col("balance_set"), F.col("balance")).otherwise(F.col("before_balance.balance"))
    current = is_applied & F.coalesce(~F.coalesce("later", F.lit(False)) & (F.col("n") == F.col("last_n")), F.lit(False)) & ~F.col("op").eqNullSafe("D")
    return out.join(around, [*KEY, "segment"], "left").select(
        "change_id", F.when(~F.col("nameless"), F.col("client")).alias("client_id"), "n", "op", "status", F.col("at").cast("int").alias("batch"),
        F.when(is_applied, F.col("n") - previous - 1).otherwise(0).cast("long").alias("missed"), F.when(is_applied, city).alias("city"), F.when(is_applied, balance).alias("balance"), current.alias("current"),
    )


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_changes(table(spark, sf_dir, "client_changes"))
    return out.select("change_id", "client_id", "status", "batch", "missed", "city", F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents"), "current")
