"""Folder trees of any depth, from an adjacency list (id, parent, name, order).

A walk around the trees, children by order and id, enters and leaves each folder once; the places of the two in the walk are its
label. A folder is below another if its places lie between the other's, so a subtree is a range, whatever its size, and neither
ancestors nor descendants are ever listed to answer for one folder. The walk is a linked list whose places come from
:func:`quillspark.operators.lists.rank`: what is written grows with the folders alone, not with their depth. A folder whose parent
is missing is a root. Ids are unique.

Folders on a ring, or below one, are in no walk. For these alone, which no tree should have, climbs are listed; a climb ends where a
folder would be met again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import lists
from quillspark.operators.relations import neighbours
from quillspark.session import discard, materialize

#: Levels that a move may lead to; trees that are deeper already stay as they are.
MAX_DEPTH = 5
#: Roots whose ranges are broadcast; more are met by equal pieces of ranges.
FEW_ROOTS = 1000
#: Places of a walk that a task goes through at least.
PLACES = 1 << 17
#: Folders whose walk one task makes, as it ends every ranking of longer ones.
FEW_FOLDERS = lists.LEAST // 2


def _walk(folders: DataFrame, text: Column, separator: str) -> DataFrame:
    """(id, enter, leave, depth, top, text) of at most FEW_FOLDERS folders, by one task; nulls on rings. ``text``: null where none is asked."""
    id_ = folders.schema["id"]
    schema = T.StructType([id_, *[T.StructField(c, T.LongType()) for c in ("enter", "leave")], T.StructField("depth", T.IntegerType()), T.StructField("top", id_.dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0]))  # nulls first, as Spark sorts
        texts, below, tops = {r[0]: r[3] for r in rows}, {}, []
        for id_, parent, *_ in rows:
            if parent in texts and parent is not None:
                below.setdefault(parent, []).append(id_)
            else:
                tops.append(id_)
        out, place, met = [], 0, set()

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), kinds)], schema=kinds)

        for top in tops:
            open_ = [[top, iter(below.get(top, ())), place, texts[top]]]
            met.add(top)
            place += 1
            while open_:
                id_, children, entered, path = open_[-1]
                child = next(children, None)
                if child is not None:
                    met.add(child)
                    open_.append([child, iter(below.get(child, ())), place, None if path is None else f"{path}{separator}{texts[child]}"])
                else:
                    open_.pop()
                    out.append((id_, entered, place, len(open_), top, path))
                    if len(out) >= 1 << 12:
                        yield batch_of(out)
                        out = []
                place += 1
        out += [(i, None, None, None, None, None) for i in texts if i not in met]
        if out:
            yield batch_of(out)

    return folders.select("id", "parent", "order", text.alias("text")).coalesce(1).mapInArrow(run, schema)


def _left_by_parent(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with what ``known`` has of their parents. The join is shuffled: broadcast, all folders would go through the driver. Roots
    stay out of it, as they would all meet in one task."""
    joined = rows.where("parent is not null").join(known.hint("shuffle_hash"), "parent", "left")
    return joined.unionByName(rows.where("parent is null"), allowMissingColumns=True)


def labels(folders: DataFrame, few: int | None = None) -> DataFrame:
    """(id, enter, leave, depth), written: places in the walk around all trees, from 0, and levels below the root; nulls on rings.
    ``few``: folders that one task may walk through, FEW_FOLDERS unless said."""
    if folders.count() <= (FEW_FOLDERS if few is None else few):
        return materialize(_walk(folders, F.lit(None).cast("string"), "").select("id", "enter", "leave", "depth"), "labels")
    parts = folders.select("id", "parent", "order")
    exists = folders.select(F.col("id").alias("__qs_p"))
    nodes = _left_by_parent(parts, exists.select(F.col("__qs_p").alias("parent"), "__qs_p")).select("id", F.col("__qs_p").alias("parent"), "order", F.monotonically_increasing_id().alias("g"))
    nodes = materialize(nodes, "folders")  # numbers stay as they are written
    beside = materialize(neighbours(nodes, [F.col("order"), F.col("id")], "g", ["parent"]), "siblings")
    ups = nodes.select(F.col("id").alias("parent"), F.col("g").alias("up"))
    first = beside.where("previous is null").select("parent", F.col("g").alias("first"))
    last = beside.where("next is null").select("parent", F.col("g").alias("last"))
    ends = first.join(last.hint("shuffle_hash"), "parent").join(ups.hint("shuffle_hash"), "parent").select(F.col("up").alias("g"), "first", "last")
    linked = _left_by_parent(beside, ups).join(ends.hint("shuffle_hash"), "g", "left")
    # folder g is entered at element 2 g and left at 2 g + 1
    enter = F.struct(
        (2 * F.col("g")).alias("e"),
        F.coalesce(2 * F.col("previous") + 1, 2 * F.col("up")).alias("pred"),
        F.coalesce(2 * F.col("first"), 2 * F.col("g") + 1).alias("succ"),
        F.when(F.col("previous").isNotNull() | F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("place"),
        F.when(F.col("previous").isNotNull(), -1).when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("depth"),
    )
    leave = F.struct(
        (2 * F.col("g") + 1).alias("e"),
        F.coalesce(2 * F.col("last") + 1, 2 * F.col("g")).alias("pred"),
        F.coalesce(2 * F.col("next"), 2 * F.col("up") + 1).alias("succ"),
        F.lit(1).cast("long").alias("place"),
        F.when(F.col("last").isNotNull(), -1).otherwise(1).cast("long").alias("depth"),
    )
    ranked = lists.rank(linked.select(F.explode(F.array(enter, leave)).alias("x")).select("x.*"), ["place", "depth"], None if few is None else max(2, few))
    inside = F.col("e") % 2 == 0
    placed = ranked.groupBy(F.expr("e div 2").alias("g")).agg(F.max(F.when(inside, F.col("place"))).alias("enter"), F.max(F.when(~inside, F.col("place"))).alias("leave"), F.max(F.when(inside, F.col("depth"))).cast("int").alias("depth"))
    out = materialize(nodes.select("id", "g").join(placed.hint("shuffle_hash"), "g", "left").drop("g"), "labels")
    for t in (nodes, beside, ranked):
        discard(t)
    return out


def _rings(folders: DataFrame, labelled: DataFrame) -> DataFrame | None:
    """Climbs of the folders that no walk meets; None if there are none."""
    met = labelled.where("enter is null").select("id")
    return None if met.isEmpty() else ancestors(folders.join(met, "id", "left_semi"))


def ancestors(folders: DataFrame) -> DataFrame:
    """(id, ancestor, distance): every folder with itself (0) and all above it, as far as they exist, each once, at its least distance:
    for those who want all pairs listed. A round joins what each folder knows of its next ancestors with what the last of these knows,
    so a tree of depth d takes log2(d) + 1 rounds."""
    nodes = folders.select("id", "parent")
    known = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    exists = folders.select(F.col("id").alias("up")).distinct()
    jump = materialize(nodes.select("id", F.col("parent").alias("up")).join(exists, "up", "left_semi"), "jump")
    reach = 1  # ancestors up to this distance, the folder itself included, are known; ``jump`` has the one at this distance
    while not jump.isEmpty():
        above = known.select(F.col("id").alias("up"), "ancestor", "distance")
        further = jump.join(above, "up").select("id", "ancestor", (F.col("distance") + reach).alias("distance"))
        before, known = known, materialize(known.unionByName(further).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")), "ancestors")
        reach *= 2
        open_ = known.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == reach).select("id")  # fewer: the root is reached, or a cycle closed
        last, jump = jump, materialize(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")).join(open_, "id", "left_semi"), "jump")
        discard(before)
        discard(last)
    return known


def _pieces(low: Column, high: Column, levels: int) -> Column:
    """The range from ``low`` to ``high`` as pieces (level, number) of 2^level places each, two of a level at most."""
    parts = []
    for level in range(levels):
        a, b = F.ceil(low / (1 << level)).cast("long"), F.floor((high + 1) / (1 << level)).cast("long")  # whole pieces of this level: a to b - 1
        # those that no larger piece holds: one at either end, where the next level begins later or ends earlier
        left = (a < b) & (a % 2 == 1)
        right = (a < b) & (b % 2 == 1) & ~(left & (b - a == 1))
        parts += [F.when(left, F.struct(F.lit(level).alias("level"), a.alias("piece"))), F.when(right, F.struct(F.lit(level).alias("level"), (b - 1).alias("piece")))]
    return F.filter(F.array(*parts), lambda p: p.isNotNull())


def descendants(folders: DataFrame, roots: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(root, id): each of ``roots`` (root) with the folders below it, itself included. ``labelled``: :func:`labels`, if at hand."""
    labelled = labels(folders) if labelled is None else labelled
    distinct = roots.select("root").distinct()
    asked = distinct.join(labelled.select(F.col("id").alias("root"), F.col("enter").alias("low"), F.col("leave").alias("high")), "root")
    places = labelled.where("enter is not null").select("id", "enter")
    if asked.count() <= FEW_ROOTS:
        found = places.join(F.broadcast(asked), (F.col("enter") >= F.col("low")) & (F.col("enter") <= F.col("high")))
    else:
        levels = max(1, (labelled.agg(F.max("leave")).first()[0] or 0).bit_length() + 1)
        cut = asked.where("low is not null").select("root", F.explode(_pieces(F.col("low"), F.col("high"), levels)).alias("p")).select("root", "p.*")
        each = places.select("id", F.posexplode(F.array(*[F.shiftright("enter", level) for level in range(levels)])).alias("level", "piece"))
        found = each.join(cut, ["level", "piece"])
    rings = _rings(folders, labelled)
    found = found.select("root", "id")
    return found if rings is None else found.unionByName(rings.join(distinct, F.col("ancestor") == F.col("root")).select("root", "id"))


def depths(folders: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id, depth): 0 for a root."""
    labelled = labels(folders) if labelled is None else labelled
    found, rings = labelled.where("enter is not null").select("id", "depth"), _rings(folders, labelled)
    return found if rings is None else found.unionByName(rings.groupBy("id").agg(F.max("distance").alias("depth")))


def heights(folders: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(id, height): levels below each folder, 0 for none.

    The walk is cut into blocks of places. A task goes along a block with the folders that are open: one that is left there too has
    its height at once; one that is left in a later block takes the deepest of its block's rest, of the blocks between, of which
    there are a few numbers in all, and of the other block's beginning.
    """
    labelled = labels(folders) if labelled is None else labelled
    spark = folders.sparkSession
    walk = labelled.where("enter is not null")
    n = 2 * walk.count()
    size = max(PLACES, -(-n // max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    steps = walk.select("id", "depth", F.explode(F.array(F.struct(F.col("enter").alias("at"), F.lit(True).alias("into")), F.struct(F.col("leave").alias("at"), F.lit(False).alias("into")))).alias("s"))
    steps = steps.select("id", "depth", F.expr(f"s.at div {size}").cast("int").alias("block"), "s.at", "s.into")
    dealt = steps.repartition("block").sortWithinPartitions("at").select("id", "depth", "block", "into")
    kind = labelled.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("part", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("most", T.IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out_schema = to_arrow_schema(schema)
        out: list[tuple] = []
        open_: list[list] = []  # id, depth, deepest so far
        block, most = None, 0

        def close() -> None:
            below = 0
            while open_:
                name, depth, deepest = open_.pop()
                below = max(below, deepest)
                out.append((name, "begun", block, depth, below))
            if block is not None:
                out.append((None, "all", block, 0, most))

        for batch in batches:
            for name, depth, of, into in zip(*(c.to_pylist() for c in batch.columns)):
                if of != block:
                    close()
                    block, most = of, 0
                if into:
                    open_.append([name, depth, depth])
                    most = max(most, depth)
                elif open_:
                    _, depth, deepest = open_.pop()
                    out.append((name, "whole", of, depth, deepest))
                    if open_ and deepest > open_[-1][2]:
                        open_[-1][2] = deepest
                else:
                    out.append((name, "ended", of, depth, most))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)

    made = materialize(dealt.mapInArrow(run, schema), "heights")
    whole = made.where("part = 'whole'").select("id", (F.col("most") - F.col("depth")).alias("height"))
    begun = made.where("part = 'begun'").select("id", "depth", F.col("block").alias("a"), F.col("most").alias("rest"))
    ended = made.where("part = 'ended'").select("id", F.col("block").alias("b"), F.col("most").alias("start"))
    between = made.where("part = 'all'").agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "most"))), lambda x: x["most"]).alias("all"))  # a number for each block
    found = whole
    if n > size:
        spans = begun.join(ended.hint("shuffle_hash"), "id").join(F.broadcast(between))
        inner = F.when(F.col("b") - F.col("a") > 1, F.array_max(F.slice("all", F.col("a") + 2, F.col("b") - F.col("a") - 1))).otherwise(0)
        found = whole.unionByName(spans.select("id", (F.greatest("rest", "start", inner) - F.col("depth")).alias("height")))
    rings = _rings(folders, labelled)
    return found if rings is None else found.unionByName(rings.groupBy(F.col("ancestor").alias("id")).agg(F.max("distance").alias("height")))


def _climb(folders: DataFrame, text: Column, separator: str, few: int | None = None) -> DataFrame:
    """(id, top, depth, text, up): ``text`` from the root down, joined; the root; null where a climb doesn't end (and ``up`` isn't null).

    Each folder knows what leads to some ancestor, and joins that one's: twice a round, so that a round goes four times as far.
    Folders that have met their root take no part any more.
    """
    if folders.count() <= (FEW_FOLDERS if few is None else few):
        walked = materialize(_walk(folders, text, separator), "climb")
        return walked.select("id", F.when(F.col("enter").isNull(), F.col("id")).alias("up"), "text", "depth", "top")
    exists = folders.select(F.col("id").alias("__qs_p"))
    start = folders.join(exists, F.col("parent") == F.col("__qs_p"), "left").select("id", F.col("__qs_p").alias("up"), text.alias("text"), F.lit(0).alias("depth"))
    ready, known = None, materialize(start.withColumn("top", F.when(F.col("up").isNull(), F.col("id"))), "climb")
    open_ = known.where("up is not null").count()
    while open_:
        after = known
        for _ in range(2):
            above = after.select(F.col("id").alias("up"), F.col("up").alias("__qs_up"), F.col("text").alias("__qs_text"), F.col("depth").alias("__qs_depth"), F.col("top").alias("__qs_top"))
            further = after.join(above, "up", "left")
            after = further.select(
                "id",
                F.col("__qs_up").alias("up"),
                F.concat_ws(separator, "__qs_text", "text").alias("text"),
                (F.col("depth") + F.when(F.col("up").isNotNull(), F.col("__qs_depth") + 1).otherwise(0)).alias("depth"),
                F.coalesce("top", "__qs_top").alias("top"),
            )
        last, known = known, materialize(after, "climb")
        discard(last)
        before, open_ = open_, known.where("up is not null").count()
        if open_ == before:
            break  # whoever is left climbs for ever
    return known


def paths(folders: DataFrame, separator: str = " / ", few: int | None = None) -> DataFrame:
    """(id, path): names from the root down. Written in rounds of as many rows as there are folders, log4(depth) + 1 of them."""
    climbed = _climb(folders, F.coalesce("name", F.lit("")), separator, few)
    found = climbed.where("up is null").select("id", F.col("text").alias("path"))
    rings = climbed.where("up is not null").select("id")
    if rings.isEmpty():
        return found
    named = ancestors(folders.join(rings, "id", "left_semi")).join(folders.select(F.col("id").alias("ancestor"), "name"), "ancestor")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))), lambda s: s["name"])
    return found.unionByName(named.groupBy("id").agg(F.array_join(ordered, separator).alias("path")))


def check_moves(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (id, target; null for the root) with a verdict: CIRCULAR, MAX_DEPTH or OK."""
    labelled = labels(folders)
    named = moves.select("id").union(moves.select(F.col("target").alias("id"))).distinct()
    asked = lambda df: df.join(named, "id", "left_semi")  # noqa: E731  of all folders, those that are moved or moved to
    spots = asked(labelled)
    mine = spots.select("id", "enter", "leave")
    theirs = spots.select(F.col("id").alias("target"), F.col("enter").alias("at"))
    checked = moves.join(mine, "id", "left").join(theirs, "target", "left").withColumn("below", (F.col("at") >= F.col("enter")) & (F.col("at") <= F.col("leave")))
    rings = _rings(folders, labelled)
    if rings is not None:
        ringed = asked(rings).select(F.col("id").alias("target"), F.col("ancestor").alias("id"), F.lit(True).alias("ring"))
        checked = checked.join(ringed, ["id", "target"], "left").withColumn("below", F.coalesce("ring", "below"))
    checked = checked.join(asked(depths(folders, labelled)).select(F.col("id").alias("target"), "depth"), "target", "left").join(asked(heights(folders, labelled)), "id", "left")
    deep = F.coalesce(F.col("depth"), F.lit(0)) + 1 + F.coalesce(F.col("height"), F.lit(0)) >= MAX_DEPTH
    verdict = F.when(F.col("below"), "CIRCULAR").when(F.col("target").isNotNull() & deep, "MAX_DEPTH").otherwise("OK")
    return checked.select("id", "target", verdict.alias("verdict"))


def delete_subtree(folders: DataFrame, documents: DataFrame, root, now) -> tuple[DataFrame, DataFrame]:
    """Folders with a subtree marked as deleted, and documents taken out of it."""
    spark = folders.sparkSession
    gone = descendants(folders, spark.range(1).select(F.lit(root).alias("root"))).select(F.col("id").alias("gone")).distinct()
    marked = folders.join(gone, F.col("id") == F.col("gone"), "left")
    marked = marked.withColumn("deleted_at", F.when(F.col("gone").isNotNull(), now).otherwise(F.col("deleted_at"))).drop("gone")
    freed = documents.join(gone, F.col("folder_id") == F.col("gone"), "left")
    return marked, freed.withColumn("folder_id", F.when(F.col("gone").isNull(), F.col("folder_id"))).drop("gone")


def empty_folder(folders: DataFrame, documents: DataFrame, folder) -> tuple[DataFrame, DataFrame]:
    """A folder's documents go to the root, its subfolders to its parent."""
    grand = folders.where(F.col("id") == folder).select(F.col("id").alias("__qs_f"), F.col("parent").alias("__qs_p"))
    moved = folders.join(F.broadcast(grand), F.col("parent") == F.col("__qs_f"), "left")
    moved = moved.withColumn("parent", F.when(F.col("__qs_f").isNotNull(), F.col("__qs_p")).otherwise(F.col("parent"))).drop("__qs_f", "__qs_p")
    return moved, documents.withColumn("folder_id", F.when(~F.col("folder_id").eqNullSafe(F.lit(folder)), F.col("folder_id")))


def restore_documents(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """Documents restored; one whose folder is gone or deleted comes back at the root."""
    live = folders.where("deleted_at is null").select(F.col("id").alias("__qs_live"))
    joined = documents.join(live, F.col("folder_id") == F.col("__qs_live"), "left")
    return joined.withColumns({"deleted_at": F.lit(None).cast("timestamp"), "folder_id": F.col("__qs_live")}).drop("__qs_live")


def tree(folders: DataFrame, separator: str = "/", few: int | None = None) -> DataFrame:
    """(id, depth, sort_path): folders in the order of a tree, siblings by ``order`` and id; orphans, whose parent is missing, are left
    out, and so is what lies on or below a ring."""
    key = F.format_string("%08d:%s", F.col("order"), F.col("id").cast("string"))
    roots = folders.where("parent is null").select(F.col("id").alias("top"))
    return _climb(folders, key, separator, few).where("up is null").join(roots, "top", "left_semi").select("id", "depth", F.col("text").alias("sort_path"))
