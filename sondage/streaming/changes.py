"""Change events: coalescing, the plan of a flush, and a stream that applies flushes to the index.

coalesced() keeps, for each key, what came after its last removal: the first
structural action decides, a modification is a flag.

tracked() has the full rules, with renames and moves. A lane is a path between
two times that it is moved away; a lane's events are folded in order into a
state (first action, old path, modified, content hash), and a lane that is
moved hands its state on to the lane it is moved to. Lanes without a move into
them are final after one fold, and each further round settles those one move
behind, so there are as many rounds as the longest chain of moves in the batch.
Lanes are folded on their own; what a folder's events are brought together for
is the event before each (a window over one batch's events of the folder).
tracker.py keeps the state between batches instead.

Rules: an addition stays one through renames; renames chain to the first old
path; a removal clears what came before it; a removal right after an addition
of the same name is a move from the added path to the removed one; content
counts as modified if its hash is known and differs; any event on a private
database is its removal. A modification alone moves on with its file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import private_database

ADD, REMOVE, MODIFIED, OLD_NAME, NEW_NAME = "add", "remove", "modified", "old_name", "new_name"
_STATE = "struct<first:string,old:string,modified:boolean,content:string>"


def coalesced(changes: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, first_action, modified). changes: key, action, and an order."""
    cut = F.max(F.when(F.col("action") == "remove", F.col(order))).over(Window.partitionBy(key))
    live = changes.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col(order) >= F.col("_cut")))
    return live.groupBy(key).agg(
        F.min_by(F.when(F.col("action") != "modified", F.col("action")), F.when(F.col("action") != "modified", F.col(order))).alias("first_action"),
        F.coalesce(F.bool_or(F.col("action") == "modified"), F.lit(False)).alias("modified"),
    )


def planned(rows: DataFrame) -> DataFrame:
    a, m = F.col("first_action"), F.col("modified")
    plan = F.when(a.isNull() & m, "delete and add").when(a == "remove", "delete").when(a == "add", "add").when((a == "rename") & m, "delete old and add").when(a == "rename", "rename")
    return rows.withColumn("plan", plan)


def _steps(events: DataFrame, folder: str, order: str) -> DataFrame:
    """folder, order, path, what, content, source: what happens to which path. A move is an out at its source and an in, two rows."""
    by = Window.partitionBy(folder).orderBy(order)
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    path, event = F.col("path"), F.when(private_database(F.col("path")), REMOVE).otherwise(F.col("event"))
    seen = events.select(folder, order, path, event.alias("event"), "content", private_database(path).alias("private"))
    seen = seen.withColumn("before", F.lag("path").over(by)).withColumn("event_before", F.lag("event").over(by))
    moved = (F.col("event") == NEW_NAME) | ((F.col("event") == REMOVE) & ~F.col("private") & (F.col("event_before") == ADD) & (name(F.col("before")) == name(path)))
    seen = seen.withColumn("source", F.when(moved & (F.col("before") != path), F.col("before"))).where((F.col("event") != OLD_NAME) & ((F.col("event") != NEW_NAME) | F.col("source").isNotNull()))
    step = lambda path, what, content, source: F.struct(path.alias("path"), F.lit(what).alias("what") if isinstance(what, str) else what.alias("what"), content.alias("content"), source.alias("source"))
    nothing = F.lit(None).cast("string")
    both = F.array(step(F.col("source"), "out", nothing, nothing), step(path, "in", nothing, F.col("source")))
    one = F.array(step(path, F.col("event"), F.col("content"), nothing))
    return seen.select(folder, order, F.explode(F.when(F.col("source").isNotNull(), both).otherwise(one)).alias("s")).select(folder, order, "s.*")


def _fold(steps: Column) -> Column:
    """The state after a lane's steps, an array in order of structs (order, what, content, source, carried)."""

    def after(state: Column, s: Column) -> Column:
        carried, what = s["carried"], s["what"]
        # What a move brings: an addition stays one, a rename keeps its first old path, anything else is renamed from its source.
        brought = F.when(carried["first"].isin(ADD, "rename"), carried["first"]).otherwise("rename")
        came_from = F.when(carried["first"] == ADD, F.lit(None)).when(carried["first"] == "rename", carried["old"]).otherwise(s["source"])
        action = F.when(what == ADD, F.lit(ADD)).when(what == "in", brought)
        differs = F.coalesce(state["content"] != s["content"], F.lit(False))
        first = F.when(what == REMOVE, REMOVE).otherwise(F.coalesce(state["first"], action))
        old = F.when(what == REMOVE, F.lit(None)).when((what == "in") & state["first"].isNull(), came_from).otherwise(state["old"])
        modified = F.when(what == REMOVE, False).when(what == MODIFIED, differs).when(what == "in", state["modified"] | F.coalesce(carried["modified"], F.lit(False))).otherwise(state["modified"])
        content = F.when(what == MODIFIED, F.coalesce(s["content"], state["content"])).when(what == "in", F.coalesce(carried["content"], state["content"])).otherwise(state["content"])
        return F.struct(first.alias("first"), old.cast("string").alias("old"), modified.alias("modified"), content.alias("content")).cast(_STATE)

    start = F.struct(F.lit(None).alias("first"), F.lit(None).alias("old"), F.lit(False).alias("modified"), F.first("known").alias("content")).cast(_STATE)
    return F.aggregate(F.sort_array(steps), start, after)


def lanes(events: DataFrame, folder: str = "folder", order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """(folder, path, lane, moved, state) of a batch. known: path, content of files seen before, whose hashes a batch may keep for the next."""
    steps = _steps(events, folder, order)
    out = (F.col("what") == "out").cast("int")
    lane = F.coalesce(F.sum(out).over(Window.partitionBy(folder, "path").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    steps = steps.withColumn("lane", lane)
    sources = steps.where("what = 'out'").select(folder, order, F.col("path").alias("source"), F.col("lane").alias("from"))
    steps = steps.join(sources, [folder, order, "source"], "left")
    before = known.select("path", F.col("content").alias("known")) if known is not None else steps.sparkSession.createDataFrame([], "path string, known string")
    steps = steps.join(before, "path", "left").withColumn("known", F.when(F.col("lane") == 0, F.col("known"))).cache()
    own = [folder, "path", "lane"]
    rounds, found = 0, None
    while True:
        if found is None:
            met = steps.withColumn("carried", F.lit(None).cast(_STATE))
        else:
            brought = found.select(folder, F.col("path").alias("source"), F.col("lane").alias("from"), F.col("state").alias("carried"))
            met = steps.join(brought, [folder, "source", "from"], "left")
        folded = met.groupBy(*own).agg(
            _fold(F.collect_list(F.struct(order, "what", "content", "source", "carried"))).alias("state"), F.bool_or(F.col("what") == "out").alias("moved")
        ).cache()
        changed = found is None or folded.alias("a").join(found.alias("b"), own).where(~F.col("a.state").eqNullSafe(F.col("b.state"))).limit(1).count()
        if found is not None:
            found.unpersist()
        found, rounds = folded, rounds + 1
        if not changed:
            return found


def tracked(events: DataFrame, folder: str = "folder", order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """(folder, operation, path, old) of a batch of events: folder, seq, event, path, content."""
    end = lanes(events, folder, order, known).where("not moved").select(folder, "path", "state.*")
    first, modified, row = F.col("first"), F.col("modified"), lambda operation, path, old=None: F.struct(F.lit(operation).alias("operation"), path.alias("path"), (F.lit("") if old is None else old).alias("old"))
    path, old = F.col("path"), F.col("old")
    todo = (
        F.when(first.isNull() & modified, F.array(row("delete", path), row("add", path)))
        .when(first == REMOVE, F.array(row("delete", path)))
        .when(first == ADD, F.array(row("add", path)))
        .when((first == "rename") & modified, F.array(row("delete", old), row("add", path)))
        .when(first == "rename", F.array(row("rename", path, old)))
    )
    return end.select(folder, F.explode(todo).alias("todo")).select(folder, "todo.*")


def source(spark: SparkSession, folder: str, schema: str, files: int = 500) -> DataFrame:
    """Change events that arrive as JSON files in a folder, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def watch(events: DataFrame, flush: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Plans each micro-batch and hands it to flush. Without seconds it takes what there is and ends.

    Batches follow one another, so one flush runs at a time. The bound of events
    for a flush is the source's own (maxFilesPerTrigger and the like)."""
    writer = events.writeStream.foreachBatch(lambda batch, n: flush(planned(coalesced(batch)), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by hour of event time, with late events accepted for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
