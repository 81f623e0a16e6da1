"""Closure of effective-dated hierarchies, of any depth and with cycles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import counted, folder, written

LEVELS, ROUNDS = 3, 4  # levels of one job, and jobs, before reach is doubled

#: The relations that contain: only along these do suppressions pass down.
CONTAINING = ("part_of", "reports_to", "operated_by")


def effective(edges: DataFrame, as_of: date | str | None) -> DataFrame:
    """Edges in force on a day, both ends included, an open end without one; all edges if no day is given."""
    if as_of is None:
        return edges
    day = F.lit(as_of).cast("date")
    return edges.filter((F.col("effective_from").isNull() | (F.col("effective_from") <= day)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)))


def containing(edges: DataFrame, kind: str = "kind") -> DataFrame:
    return edges.filter(F.col(kind).isin(*CONTAINING))


def _shared(spark: SparkSession) -> str:
    return folder(spark, "graph")


def _written(df: DataFrame, path: str, step: int) -> DataFrame:
    return written(df, f"{path}/{step}")


def _observed(df: DataFrame, path: str, going_on: Column) -> tuple[DataFrame, int]:
    """df as a table, and the number of its rows from which ways go on."""
    seen = Observation()
    df.observe(seen, F.count_if(going_on).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), int(seen.get["n"])


def ancestry(nodes: DataFrame, edges: DataFrame, most: int = 12, as_of: date | str | None = None) -> DataFrame:
    """(node, ancestor, depth) with the nodes themselves at depth 0, from (parent, child), up to depth `most`: one row
    for each depth at which an ancestor is reached.

    Reach doubles: ways of up to k steps, joined behind those of exactly k, give all up to 2k. Each round writes what
    is new; the loop ends where no way of k steps is left. With as_of, only edges in force on that day
    (effective_from, effective_to) count.
    """
    spark, home = nodes.sparkSession, _shared(nodes.sparkSession)
    wanted = nodes.select("node").distinct()
    up = effective(edges, as_of).select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    if most < 1:
        return wanted.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))

    last = _written(up, home, 1)
    reach, paths = 1, [f"{home}/1"]
    while reach < most:
        known = spark.read.schema(last.schema).parquet(*paths)
        ends = last.filter(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        after = known.filter(F.col("depth") <= most - reach).select(F.col("node").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        last, n = counted(ends.join(after, "via").select("node", "ancestor", "depth").distinct(), f"{home}/{2 * reach}")
        if not n:
            break
        reach *= 2
        paths.append(f"{home}/{reach}")
    ways = spark.read.schema(last.schema).parquet(*paths).join(wanted, "node", "left_semi")
    return ways.union(wanted.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))


def nearest(closure: DataFrame) -> DataFrame:
    """(node, ancestor, depth) with each ancestor once, at its least depth; nodes themselves left out."""
    return closure.filter("depth > 0 and node != ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def closure(steps: DataFrame) -> DataFrame:
    """(node, to, depth): all that can be reached along (node, next), each once, at its least depth, whatever the depth
    and through cycles. Reach doubles as in ancestry(): a way of d steps, k < d <= 2k, is one of k steps and one of at
    most k; only pairs not yet known go on."""
    spark, home = steps.sparkSession, _shared(steps.sparkSession)
    last = _written(steps.select("node", F.col("next").alias("to"), F.lit(1).alias("depth")).distinct(), home, 1)
    paths, reach = [f"{home}/1"], 1
    while True:
        known = spark.read.schema(last.schema).parquet(*paths)
        ends = last.filter(F.col("depth") == reach).select("node", F.col("to").alias("via"))
        after = ends.join(known.withColumnRenamed("node", "via"), "via").groupBy("node", "to").agg((F.min("depth") + reach).alias("depth"))
        last, n = counted(after.join(known.select("node", "to"), ["node", "to"], "left_anti"), f"{home}/{2 * reach}")
        if not n:
            return known
        reach *= 2
        paths.append(f"{home}/{reach}")


def _walked(starts: DataFrame, steps: DataFrame, own: list[str], home: str) -> tuple[DataFrame, DataFrame | None]:
    """(*own, node, depth) of all that (*own, node) reach along (node, next), at least depth, themselves at 0; and those
    at which the walk was stopped after ROUNDS jobs, None if it ended. Only what is in reach is touched; a job takes
    LEVELS levels at once."""
    spark = starts.sparkSession
    front = _written(starts.select(*own, "node", F.lit(0).alias("depth")).filter("node is not null").distinct(), home, 0)
    paths = [f"{home}/0"]
    for k in range(1, ROUNDS + 1):
        known = spark.read.schema(front.schema).parquet(*paths)
        level, levels = front, None
        for _ in range(LEVELS):
            level = level.join(steps, "node").select(*own, F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"))
            levels = level if levels is None else levels.union(level)
        least = levels.groupBy(*own, "node").agg(F.min("depth").alias("depth"))
        end = F.col("depth") == k * LEVELS
        new, going = _observed(least.join(known, [*own, "node"], "left_anti").select(*known.columns), f"{home}/{k}", end)
        paths.append(f"{home}/{k}")
        if not going:
            return spark.read.schema(front.schema).parquet(*paths), None
        front = new.filter(end)
    return spark.read.schema(front.schema).parquet(*paths), front


def reached(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(node, to, depth): for each of nodes all that (node, next) lead to, at least depth, itself at 0, through cycles and
    however deep. What lies far is closed by doubled reach, among the nodes beyond the walk alone."""
    home = _shared(nodes.sparkSession)
    steps = _written(steps.select("node", "next").distinct(), home, -1)
    own = nodes.select(F.col("node").alias("origin"), "node").distinct()
    known, front = _walked(own, steps, ["origin"], home)
    out = known.select(F.col("origin").alias("node"), F.col("node").alias("to"), "depth")
    if front is None:
        return out
    beyond = _far(front.select("node").distinct(), steps.select(F.col("node").alias("parent"), F.col("next").alias("child")), f"{home}/far")
    far = closure(steps.join(beyond, "node", "left_semi"))
    more = front.select("origin", F.col("node").alias("via"), F.col("depth").alias("before")).join(far.withColumnRenamed("node", "via"), "via")
    more = more.groupBy(F.col("origin").alias("node"), "to").agg(F.min(F.col("before") + F.col("depth")).alias("depth"))
    return out.union(more.join(out, ["node", "to"], "left_anti").select("node", "to", "depth"))


def hierarchy(nodes: DataFrame, edges: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """(node, ancestor, depth): every ancestor of each node, nearest depth, several parents, cycles and any depth; a
    node is not its own ancestor."""
    up = effective(edges, as_of).select(F.col("child").alias("node"), F.col("parent").alias("next"))
    return reached(nodes, up).filter("node != to").select("node", F.col("to").alias("ancestor"), "depth")


def descendants(nodes: DataFrame, edges: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """(node, descendant), the node itself included."""
    down = effective(edges, as_of).select(F.col("parent").alias("node"), F.col("child").alias("next"))
    return reached(nodes, down).select("node", F.col("to").alias("descendant"))


def _far(roots: DataFrame, edges: DataFrame, home: str) -> DataFrame:
    """(node): roots and all below them. In round k, nodes join whose ancestor 2^k steps up is known; edges double for
    the next round. A round without new nodes ends it: then none lies as far below the roots as that, nor further."""
    spark = roots.sparkSession
    jump, known = edges.select("child", "parent").distinct(), _written(roots.select("node").distinct(), home, 1)
    jump = _written(jump, home, 0)
    paths, step = [f"{home}/1"], 1
    while True:
        below = jump.join(known.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        new, n = counted(below.join(known, "node", "left_anti"), f"{home}/{step + 1}")
        if not n:
            return known
        paths.append(f"{home}/{step + 1}")
        known = spark.read.schema(new.schema).parquet(*paths)
        twice = jump.withColumnRenamed("parent", "via").join(jump.withColumnRenamed("child", "via"), "via").select("child", "parent").distinct()
        jump = _written(twice, home, step + 2)
        step += 2


def subtree(roots: DataFrame, edges: DataFrame, as_of: date | str | None = None) -> DataFrame:
    """(node): roots (node) and all below them, however deep; cycles end where they meet what is known. With as_of,
    only edges in force on that day count. The walk goes down from the roots and meets nothing else; where it has not
    ended after ROUNDS jobs, reach doubles among the edges whose child isn't known yet."""
    home = _shared(roots.sparkSession)
    steps = effective(edges, as_of).select(F.col("parent").alias("node"), F.col("child").alias("next"))
    known, front = _walked(roots, steps, [], home)
    known = known.select("node")
    if front is None:
        return known
    left = steps.join(known.withColumnRenamed("node", "next"), "next", "left_anti").select(F.col("node").alias("parent"), F.col("next").alias("child"))
    return known.union(_far(front.select("node"), left, f"{home}/far")).distinct()


def _core(edges: DataFrame, n: int, home: str, rounds: int = 8, own: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Of n edges those that remain when ends without a way on and starts without a way in are taken off, again and
    again: no cycle passes the others. It only spares work, so it stops after some rounds. Each value of own is a graph
    for itself."""
    for k in range(rounds if n else 0):
        on, into = edges.select(*own, F.col("child").alias("parent")).distinct(), edges.select(*own, F.col("parent").alias("child")).distinct()
        left = edges.join(on, [*own, "parent"], "left_semi").join(into, [*own, "child"], "left_semi").select(*edges.columns)
        before, (edges, n) = n, counted(left, f"{home}/core-{k}")
        if n in (before, 0):
            break
    return edges, n


def _labels(edges: DataFrame, home: str, own: tuple[str, ...]) -> DataFrame:
    """(*own, node, up, down): the least node that leads to each node, and the least that it leads to, itself included.
    Labels pass along edges; each round they also take the label of the node that they name, so that ways double."""
    spark = edges.sparkSession
    ends = edges.select(*own, F.col("child").alias("node")).union(edges.select(*own, F.col("parent").alias("node"))).distinct()
    labels, k = written(ends.select(*own, "node", F.col("node").alias("up"), F.col("node").alias("down")), f"{home}/0"), 0
    none = F.lit(None).cast(labels.schema["node"].dataType)
    while True:
        on = edges.join(labels.withColumnRenamed("node", "child"), [*own, "child"]).select(*own, F.col("parent").alias("node"), "up", none.alias("down"), none.alias("_up"), none.alias("_down"))
        back = edges.join(labels.withColumnRenamed("node", "parent"), [*own, "parent"]).select(*own, F.col("child").alias("node"), none.alias("up"), "down", none.alias("_up"), none.alias("_down"))
        least = labels.select(*own, "node", "up", "down", F.col("up").alias("_up"), F.col("down").alias("_down")).union(on).union(back)
        least = least.groupBy(*own, "node").agg(*[F.min(c).alias(c) for c in ("up", "down", "_up", "_down")])
        for c in ("up", "down"):
            least = least.join(labels.select(*own, F.col("node").alias(c), F.col(c).alias("far")), [*own, c]).withColumn(c, F.least(c, "far")).drop("far")
        k += 1
        new, n = _observed(least.select(*own, "node", "up", "down", "_up", "_down"), f"{home}/{k}", (F.col("up") < F.col("_up")) | (F.col("down") < F.col("_down")))
        labels = spark.read.schema(new.schema).parquet(f"{home}/{k}").select(*own, "node", "up", "down")
        if not n:
            return labels


def _strong(edges: DataFrame, home: str, own: tuple[str, ...] = ()) -> DataFrame | None:
    """(*own, child, parent, label): of the edges (*own, child, parent) those that lie on a cycle, with the least node of
    their strongly connected component; None if there are none. Each value of own is a graph for itself.

    Nodes whose least node before them and least node after them are one belong to that node's component; of the
    others only edges whose ends agree in both may lie within one, and go on."""
    spark = edges.sparkSession
    edges, n = counted(edges.select(*own, "child", "parent").distinct(), f"{home}/all")
    paths, k = [], 0
    while True:
        edges, n = _core(edges, n, f"{home}/{k}", own=own)
        if not n:
            return spark.read.schema(schema).parquet(*paths) if paths else None
        labels = _labels(edges, f"{home}/{k}/labels", own)
        ends = [labels.select(*own, F.col("node").alias(c), F.struct("up", "down").alias(f"_{c}")) for c in ("child", "parent")]
        same = edges.join(ends[0], [*own, "child"]).join(ends[1], [*own, "parent"]).filter("_child = _parent")
        same = written(same.select(*own, "child", "parent", F.col("_child.up").alias("label"), F.col("_child.down").alias("_down")), f"{home}/{k}/same")
        done, _ = _observed(same.filter("label = _down").select(*own, "child", "parent", "label"), f"{home}/{k}/done", F.lit(True))
        schema = done.schema
        paths.append(f"{home}/{k}/done")
        edges, n = counted(same.filter("label != _down").select(*own, "child", "parent"), f"{home}/{k}/left")
        k += 1


def cycles(edges: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """(node): nodes from which edges (child, parent, effective_from, effective_to) lead back to themselves at a time when
    all edges on the way are in force. With `new`, further edges of the same form: their children that a cycle through
    one of them comes back to, with all edges there are.

    A cycle in force on some day is so on a day on which one of its edges begins, and lies in one strongly connected
    component both of all edges and of that day's. So the days on which a component's edges begin are enough, with
    `new` those with a new edge in force. Rows are edges times such days, whatever the number of ways; no pair of nodes
    that are not neighbours is ever kept.
    """
    home = _shared(edges.sparkSession)

    def dated(e: DataFrame) -> DataFrame:
        since, until = F.coalesce("effective_from", F.lit("0001-01-01").cast("date")), F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))
        return e.select("child", "parent", since.alias("since"), until.alias("until")).filter("since <= until").distinct()

    none = edges.select(F.col("child").alias("node")).limit(0)
    every = dated(edges)
    if new is not None:
        every = every.union(dated(new)).distinct()
    every = written(every, f"{home}/edges")
    whole = _strong(every, f"{home}/whole")
    if whole is None:
        return none
    within = written(every.join(whole, ["child", "parent"]), f"{home}/within")
    days = within.groupBy("label").agg(F.collect_set("since").alias("days"))
    in_force = F.explode(F.filter("days", lambda d: (d >= F.col("since")) & (d <= F.col("until"))))
    if new is not None:
        first = written(within.join(dated(new), ["child", "parent", "since", "until"], "left_semi").select(*within.columns), f"{home}/first")
        days = first.join(days, "label").select("label", in_force.alias("day")).groupBy("label").agg(F.collect_set("day").alias("days"))
    days = written(days, f"{home}/days")
    daily = within.join(days, "label").select(in_force.alias("day"), "child", "parent")
    found = _strong(daily, f"{home}/daily", ("day",))
    if found is None:
        return none
    if new is not None:
        found = first.drop("label").join(found, ["child", "parent"]).filter("day between since and until")
    return found.select(F.col("child").alias("node")).distinct()
