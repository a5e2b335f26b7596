"""Job hierarchy and job-state tables.

Jobs are an adjacency list ``(name, parent)``; job state is an append-only
log ``(name, ts, pct_complete)`` instead of row updates.  Recursion is
pointer doubling: one equi-join a round, as many rounds as the logarithm of the depth, each
written to the shared checkpoint folder.  Nodes with several parents are the ends of the doubled ways and are
settled by rounds over the contracted graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsfolds.functions import safe_div
from tsfolds.plans import blocked
from tsfolds.session import stored


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An equi-join that deals both sides by the key.  The tables of a round are as large as all nodes, yet their
    compressed files may look small enough to broadcast, and then every round would send them through the driver."""
    return left.join(right.hint("shuffle_hash"), on, how)


def _doubled(state: DataFrame, merge: dict) -> DataFrame:
    """Pointer doubling.  ``state`` has a row per ``node`` with ``to``, another row's node or NULL at the end of the way, and
    what is known of the way so far; ``merge`` says how a row's columns grow by those (``n_<column>``) of the row it points
    at.  A round doubles every way, so ways of 2**r steps end after r rounds; a row that still points on after the
    logarithm of all rows is on or behind a cycle and keeps its ``to``."""
    state = stored(state)
    known = [c for c in state.columns if c not in ("node", "to")]
    for _ in range(state.count().bit_length()):
        live = state.where("to is not null")
        if live.isEmpty():
            break
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("n_to"), *[F.col(c).alias(f"n_{c}") for c in known])
        moved = _join(live, ahead, "to").select("node", F.col("n_to").alias("to"), *[merge.get(c, F.col(c)).alias(c) for c in known])
        # rows at their end do not take part: they would meet under one NULL key
        state = stored(state.where("to is null").select("node", "to", *known).unionByName(moved))
    return state


# --------------------------------------------------------------------------- C6 C7 C8


def workers_of(workers: DataFrame, jobs: DataFrame, parent: str | None = None) -> DataFrame:
    """Workers joined to their job (inner), optionally only the jobs under
    ``parent``."""
    j = jobs.select(F.col("name").alias("jobname"), F.col("parent").alias("job_parent"))
    if parent is not None:
        j = j.where(F.col("job_parent") == parent)
    return workers.join(j, "jobname")


def orphans(workers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Workers whose job does not exist (the foreign-key violations)."""
    return workers.join(jobs.select(F.col("name").alias("jobname")), "jobname", "left_anti")


# --------------------------------------------------------------------------- I1 I2 I4


def descendants(jobs: DataFrame, root: str, name: str = "name", parent: str = "parent") -> DataFrame:
    """Every descendant of ``root`` with its level (1 = child; of several ways the shortest) and its
    parent on that way.

    Nodes with one parent are doubled up to ``root``, to a node with several parents or to a top; distances add
    up on the way.  Nodes with several parents, if there are any, are settled by least distances over
    the contracted edges between them.  A cyclic parent link reaches no root and ends.  Repeated rows count
    once; a row without a name is a leaf."""
    edges = jobs.select(F.col(name).alias("name"), F.col(parent).alias("parent")).where(F.col("parent").isNotNull())
    edges = stored(edges.where(F.col("name").isNull() | (F.col("name") != root)).distinct())
    ups = edges.where("name is not null").groupBy("name").agg(F.min("parent").alias("parent"), F.count("*").alias("ups"))
    ups = stored(ups)
    one = ups.where("ups = 1").select(F.col("name").alias("node"), F.col("parent").alias("up"))
    inner = one.select(F.col("node").alias("up"), F.lit(True).alias("inner"))
    state = _join(one, inner, "up", "left").select(
        "node", F.when(F.col("inner"), F.col("up")).alias("to"), F.when(F.col("inner").isNull(), F.col("up")).alias("end"), F.lit(1).alias("level")
    )
    state = _doubled(state, {"end": F.col("n_end"), "level": F.col("level") + F.col("n_level")})
    level = state.where(F.col("end") == root).select("node", "level")
    several = ups.where("ups > 1").select(F.col("name").alias("node"))
    if not several.isEmpty():
        level = level.unionByName(_least_levels(edges, several, state, root))
    level = level.unionByName(edges.sparkSession.createDataFrame([(root, 0)], level.schema))
    above = _join(edges, level.select(F.col("node").alias("parent"), (F.col("level") + 1).alias("level")), "parent")
    own = level.select(F.col("node").alias("name"), F.col("level").alias("_own"))
    # of a node with several parents, the ones on a shortest way
    return _join(above, own, "name", "left").where("name is null or level = _own").select("name", "parent", "level")


def _least_levels(edges: DataFrame, several: DataFrame, state: DataFrame, root: str) -> DataFrame:
    """(node, level) of the nodes with several parents and of those whose way ends at one of them."""
    ways = state.where("to is null").select("node", "end", "level")
    into = _join(edges, several.select(F.col("node").alias("name")), "name", "left_semi")
    over = _join(into, ways.withColumnRenamed("node", "parent"), "parent", "left")
    over = over.select(F.col("name").alias("node"), F.coalesce("end", "parent").alias("up"), (F.coalesce("level", F.lit(0)) + 1).alias("step"))
    over = stored(over.groupBy("node", "up").agg(F.min("step").alias("step")))
    best = stored(over.where(F.col("up") == root).select("node", F.col("step").alias("level")))
    moved = best
    while not moved.isEmpty():
        found = _join(over, moved.select(F.col("node").alias("up"), "level"), "up").groupBy("node").agg(F.min(F.col("step") + F.col("level")).alias("level"))
        old = best.withColumnRenamed("level", "_old")
        moved = stored(_join(found, old, "node", "left").where("_old is null or level < _old").select("node", "level"))
        best = stored(best.unionByName(moved).groupBy("node").agg(F.min("level").alias("level")))
    below = _join(ways, best.select(F.col("node").alias("end"), F.col("level").alias("_top")), "end")
    return best.unionByName(below.select("node", (F.col("level") + F.col("_top")).alias("level")))


def delete_subtree(jobs: DataFrame, root: str, name: str = "name", parent: str = "parent") -> DataFrame:
    """The job table without ``root`` and all its descendants."""
    gone = descendants(jobs, root, name, parent).select(F.col("name").alias(name))
    gone = gone.unionByName(jobs.where(F.col(name) == root).select(name)).distinct()
    return _join(jobs, gone, name, "left_anti")


def levels(edges: DataFrame, src: str = "parent", dst: str = "name") -> DataFrame:
    """I4: dependency level of every node (0 = no dependency; otherwise 1 + the highest level of its
    dependencies).  Nodes on or behind a cycle are reported with a NULL level and ``in_cycle`` true.

    A round places the nodes whose dependencies all are placed.  A node that waits for a single one has the level
    max(c, w + level of that one): such maps compose, so chains of waiting nodes are doubled to their end.  An
    end that is placed places the whole chain; an end that waits for several takes over the chain's edges.  So a tree
    takes one round, and any graph as many as nodes with several dependencies follow one another."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src").isNotNull()).distinct()
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    nodes = stored(nodes.unionByName(edges.where(F.col(src).isNull()).select(F.col(dst).alias("node"))).distinct())
    # open edges: level of dst >= level of src + w; bounds: level of dst >= c
    open_ = stored(e.where("dst is not null").withColumn("w", F.lit(1)))
    placed = new = stored(_join(nodes, open_.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0)))
    bound = open_.select(F.col("dst").alias("node"), F.lit(0).alias("c")).distinct()
    while not new.isEmpty() and not open_.isEmpty():
        hit = _join(open_, new.select(F.col("node").alias("src"), "level"), "src", "left")
        wait = hit.groupBy(F.col("dst").alias("node")).agg(
            F.max(F.col("level") + F.col("w")).alias("_c"),
            F.count(F.when(F.col("level").isNull(), 1)).alias("k"),
            F.max(F.when(F.col("level").isNull(), F.struct("src", "w"))).alias("one"),
        )
        wait = stored(_join(wait, bound, "node", "left").select("node", F.greatest("_c", "c").alias("c"), "k", "one.src", "one.w"))
        chain = wait.where("k = 1").select("node", F.col("src").alias("up"), "c", "w")
        inner = chain.select(F.col("node").alias("up"), F.lit(True).alias("inner"))
        chain = _join(chain, inner, "up", "left").select(
            "node", F.when(F.col("inner"), F.col("up")).alias("to"), F.when(F.col("inner").isNull(), F.col("up")).alias("end"), "c", "w"
        )
        grown = {"end": F.col("n_end"), "c": F.greatest("c", F.col("w") + F.coalesce("n_c", F.lit(0))), "w": F.col("w") + F.col("n_w")}
        chain = _doubled(chain, grown)
        done = wait.where("k = 0").select("node", F.col("c").alias("level"))
        ended = _join(chain.where("to is null"), done.select(F.col("node").alias("end"), "level"), "end", "left")
        ended = stored(ended.select("node", "end", "c", "w", F.greatest("c", F.col("w") + F.col("level")).alias("_l"), "level"))
        new = stored(done.unionByName(ended.where("level is not null").select("node", F.col("_l").alias("level"))))
        # what still waits: an edge from a chain's node comes from the chain's end instead
        left = _join(hit.where("level is null").select("src", "dst", "w"), wait.where("k > 1").select(F.col("node").alias("dst")), "dst", "left_semi")
        over = ended.where("level is null").select(F.col("node").alias("src"), "end", F.col("c").alias("_c"), F.col("w").alias("_w"))
        left = stored(_join(left, over, "src", "left"))
        hang = over.select(F.col("end").alias("src"), F.col("src").alias("dst"), F.col("_w").alias("w"))
        more = left.select(F.coalesce("end", "src").alias("src"), "dst", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        bounds = wait.where("k > 1").select("node", "c").unionByName(over.select(F.col("src").alias("node"), F.col("_c").alias("c")))
        bounds = bounds.unionByName(left.where("_c is not null").select(F.col("dst").alias("node"), (F.col("w") + F.col("_c")).alias("c")))
        open_ = stored(more.unionByName(hang).groupBy("src", "dst").agg(F.max("w").alias("w")))
        bound = stored(bounds.groupBy("node").agg(F.max("c").alias("c")))
        placed = stored(placed.unionByName(new))
    rest = _join(nodes, placed.select("node"), "node", "left_anti").where("node is not null")
    return placed.withColumn("in_cycle", F.lit(False)).unionByName(
        rest.withColumn("level", F.lit(None).cast("int")).withColumn("in_cycle", F.lit(True))
    )


# --------------------------------------------------------------------------- I3


def _rooted(jobs: DataFrame, name: str, parent: str) -> DataFrame:
    """(node, up, depth) of the nodes that have a root, one row per name; of several parents the least counts, and a
    root's ``up`` is NULL."""
    rows = jobs.select(F.col(name).alias("node"), F.col(parent).alias("up")).where(F.col("node").isNotNull())
    forest = stored(rows.groupBy("node").agg(F.min("up").alias("up")))
    state = forest.select("node", F.col("up").alias("to"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    state = _doubled(state, {"depth": F.col("depth") + F.col("n_depth")})
    return stored(_join(forest, state.where("to is null").select("node", "depth"), "node"))


def paths(jobs: DataFrame, name: str = "name", parent: str = "parent", sep: str = "/") -> DataFrame:
    """I3 as rows: every node of the job trees with the path of names from its root and its depth (root 0).
    Nodes on or behind a cycle, or under a name that has no row, have no root and no row.  A path is as long as
    its depth: use ``tree_index`` for deep trees."""
    forest = _rooted(jobs, name, parent)
    state = forest.select("node", F.col("up").alias("to"), F.col("node").alias("path"), "depth")
    state = _doubled(state, {"path": F.concat_ws(sep, "n_path", "path")})
    return state.select(F.col("node").alias("name"), "path", "depth")


def tree_index(jobs: DataFrame, name: str = "name", parent: str = "parent") -> DataFrame:
    """I3 as intervals: name, parent, depth (root 0), pre, post and size of every node of the job trees, siblings and trees in
    order of their names.  ``pre`` is the place (from 0) in the walk that meets parents before children, and the
    subtree of a node is the range ``pre .. post``: no row holds a path or a subtree.

    1. Subtree sizes: with the pointers doubled, a node adds the sizes gathered below the nodes that point at it.
    2. A node's offset from its parent is one more than the sizes of the siblings before it: a running sum over (parent, name),
       cut by ranges of names, so that a parent of very many children is no single group.
    3. ``pre`` is the sum of the offsets on the way up, doubled along the same pointers.

    Of a name with several parents the least counts.  Nodes on or behind a cycle, or under a name that has no
    row, have no row.  Rounds: three times the logarithm of the depth."""
    forest = _rooted(jobs, name, parent)
    sizes = stored(forest.select("node", F.col("up").alias("to"), F.lit(1).cast("long").alias("size")))
    while not sizes.where("to is not null").isEmpty():
        below = sizes.where("to is not null").groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("_below"))
        live = _join(sizes.where("to is not null").select("node", "to"), sizes.select(F.col("node").alias("to"), F.col("to").alias("_next")), "to").select("node", "_next")
        grown = _join(_join(sizes.select("node", "size"), below, "node", "left"), live, "node", "left")
        sizes = stored(grown.select("node", F.col("_next").alias("to"), (F.col("size") + F.coalesce("_below", F.lit(0))).alias("size")))
    placed = _sibling_offsets(_join(forest, sizes.select("node", "size"), "node"))
    state = placed.select("node", F.col("up").alias("to"), F.col("offset").alias("pre"))
    state = _doubled(state, {"pre": F.col("pre") + F.col("n_pre")}).select("node", "pre")
    out = _join(placed, state, "node")
    return out.select(F.col("node").alias("name"), F.col("up").alias("parent"), "depth", "pre", (F.col("pre") + F.col("size") - 1).alias("post"), "size")


def _sibling_offsets(sized: DataFrame) -> DataFrame:
    """``sized`` (node, up, size) with ``offset``: the sizes of the siblings of smaller names, and one for the
    parent itself where there is one."""
    part = stored(sized.repartitionByRange("up", "node").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("up", "_part").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("up", "_part").agg(F.sum("size").alias("_t"))
    # a row per part: at most the number of partitions for one parent
    before = Window.partitionBy("up").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("up", "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_carry"))
    x = blocked.null_safe_join(part.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))), carry.hint("shuffle_hash"), ["up", "_part"], "left")
    offset = F.col("_in") + F.col("_carry") + F.when(F.col("up").isNotNull(), 1).otherwise(0)
    return stored(x.withColumn("offset", offset).drop("_part", "_in", "_carry"))


def subtree(index: DataFrame, root: str) -> DataFrame:
    """The rows of ``tree_index`` in the subtree of ``root``, itself included: one range of ``pre``."""
    span = index.where(F.col("name") == root).select("pre", "post").first()
    return index.where(F.col("pre").between(span.pre, span.post)) if span else index.limit(0)


def ancestors(index: DataFrame, node: str) -> DataFrame:
    """The rows of ``tree_index`` on the way from the root to ``node``, itself included: the ranges that hold its place."""
    at = index.where(F.col("name") == node).select("pre").first()
    return index.where((F.col("pre") <= at.pre) & (F.col("post") >= at.pre)) if at else index.limit(0)


def tree(jobs: DataFrame, max_depth: int | None = None, name: str = "name", parent: str = "parent") -> DataFrame:
    """Nested job documents, empty fields dropped (``to_json`` omits
    NULLs).  Built bottom-up, one level per round: each node's document holds
    its children's documents.  A presentation operator: the size of a row is
    its subtree, so give a ``max_depth`` to show less than the whole depth."""
    if max_depth is None:
        max_depth = levels(jobs.select(F.col(name).alias("name"), F.col(parent).alias("parent"))).agg(F.max("level")).first()[0] or 0
    base = jobs.select(F.col(name).alias("name"), F.col(parent).alias("parent"))
    docs = base.select("name", "parent", F.struct(F.col("name")).alias("doc"))
    for _ in range(max_depth):
        kids = docs.groupBy(F.col("parent").alias("name")).agg(F.sort_array(F.collect_list("doc")).alias("children"))
        docs = base.join(kids, "name", "left").select(
            "name", "parent", F.struct(F.col("name"), F.col("children")).alias("doc")
        )
    return docs.where(F.col("parent").isNull()).select("name", F.to_json("doc").alias("tree"))


# --------------------------------------------------------------------------- D7 D8


def workers_csv(workers: DataFrame, by: str = "jobname", name: str = "name") -> DataFrame:
    """The comma-joined, sorted worker names of each job."""
    return workers.groupBy(by).agg(F.expr(f"listagg({name}, ',') within group (order by {name})").alias("workers"))


def worker_map(workers: DataFrame, by: str = "jobname", name: str = "name") -> DataFrame:
    """Job -> sorted list of its workers."""
    return workers.groupBy(by).agg(F.sort_array(F.collect_list(name)).alias("workers"))


# --------------------------------------------------------------------------- I5 I6 I7 I8 D9 D10


def current_state(log: DataFrame, name: str = "name", ts: str = "ts", pct: str = "pct_complete") -> DataFrame:
    """Latest reading per job (ties on the timestamp broken by the
    highest value): pct complete, last update, and status pending / running /
    complete."""
    g = log.groupBy(name).agg(
        F.max(F.struct(F.col(ts), F.col(pct))).alias("_last"),
        F.min(ts).alias("start_time"),
    )
    p = F.col("_last")[pct]
    return g.select(
        name,
        p.alias(pct),
        F.col("_last")[ts].alias("update_time"),
        "start_time",
        F.when(p >= 1.0, "complete").when(p > 0, "running").otherwise("pending").alias("status"),
    )


def status(state: DataFrame, names=None, statuses=None, name: str = "name") -> DataFrame:
    """Job status lookup by names and / or statuses."""
    out = state
    if names is not None:
        out = out.where(F.col(name).isin(list(names)))
    if statuses is not None:
        out = out.where(F.col("status").isin(list(statuses)))
    return out


def _kind(name_col) -> F.Column:
    return F.split(name_col, r"\.")[1]


def fold_jobs(runs: DataFrame, n_folds, run: str = "run", start: int = 0) -> DataFrame:
    """I8: the child jobs ``<run>.train.<i>`` and ``<run>.validate.<i>`` of
    every run for folds ``start .. n_folds-1`` (``n_folds`` may be a column)."""
    n = F.col(n_folds) if isinstance(n_folds, str) else F.lit(int(n_folds))
    x = runs.withColumn("fold", F.explode(F.sequence(F.lit(start), n - 1)))
    x = x.withColumn("kind", F.explode(F.array(F.lit("train"), F.lit("validate"))))
    return x.select(
        F.concat_ws(".", F.col(run), F.col("kind"), F.col("fold").cast("string")).alias("name"),
        F.col(run).alias("parent"),
        "kind",
        "fold",
    )


def progress(state: DataFrame, timesteps: int, parent: str = "parent", name: str = "name", pct: str = "pct_complete",
             n_folds: str | int | None = None) -> DataFrame:
    """Weighted progress of each parent job: train children count
    ``pct * timesteps``, validate children ``pct``, over
    ``(timesteps + 1) * folds`` (folds: the distinct fold indices of the
    parent's children unless given)."""
    kind = _kind(F.col(name))
    contrib = F.when(kind == "train", F.col(pct) * F.lit(float(timesteps))).when(kind == "validate", F.col(pct))
    if n_folds is None:
        folds = F.count_distinct(F.split(F.col(name), r"\.")[2])
    else:
        folds = F.max(n_folds) if isinstance(n_folds, str) else F.lit(n_folds)
    g = state.groupBy(parent).agg(F.sum(contrib).alias("_done"), folds.alias("folds"))
    return g.select(
        parent,
        "folds",
        safe_div(F.col("_done"), F.lit(float(timesteps + 1)) * F.col("folds")).alias("pct_complete"),
    )


def eta(log: DataFrame, name: str = "name", ts: str = "ts", pct: str = "pct_complete", min_delta: float = 0.0,
        exact: tuple[str, int] | None = None) -> DataFrame:
    """ETA from two successive readings of a job:
    ``eta = ts + dt / delta * (1 - pct)``, only where delta > ``min_delta``
    (elsewhere NULL); ``exact`` gives an integer column and the least step of it that must be exceeded instead.  A lag over each job's readings, split in time blocks;
    readings of one time are ordered by their value."""
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))  # no time zone involved
    step = F.col(exact[0]) if exact else F.col(pct)
    x = blocked.rolling(
        log.select(name, ts, pct, *exact[:1]) if exact else log.select(name, ts, pct), [name], ts, 1,
        lambda w: {"_dt_us": us - F.lag(us).over(w), "delta": F.col(pct) - F.lag(pct).over(w), "_step": step - F.lag(step).over(w)}, tie=pct,
    )
    secs = F.col("_dt_us") / 1e6 / F.col("delta") * (1.0 - F.col(pct))
    ok = F.col("_step") > F.lit(exact[1] if exact else min_delta)
    return x.select(
        name, ts, pct, "delta",
        F.when(ok, secs).alias("eta_secs"),
        F.when(ok, F.timestamp_add("MICROSECOND", F.floor(secs * 1e6).cast("long"), F.col(ts))).alias("eta"),
    )


def event_state(events: DataFrame, name: str = "name", ts: str = "ts", event: str = "event", pct: str = "pct_complete") -> DataFrame:
    """I5 from job events ``add`` / ``start`` / ``progress`` / ``complete``: status (of the last of add, start and
    complete; of equal times the later stage), pct complete (0 when added, the reading of a
    progress event, 1 when complete), and the last create, start and end time."""
    e = F.col(event)
    stage = F.when(e == "add", 0).when(e == "start", 1).when(e == "complete", 3).otherwise(2)
    value = F.when(e == "add", 0.0).when(e == "complete", 1.0).when(e == "progress", F.col(pct))
    at = lambda kind: F.max(F.when(e == kind, F.col(ts)))
    status = F.max(F.when(e.isin("add", "start", "complete"), F.struct(F.col(ts), stage.alias("stage"))))
    names = F.create_map(F.lit(0), F.lit("pending"), F.lit(1), F.lit("running"), F.lit(3), F.lit("complete"))
    g = events.groupBy(name).agg(
        status.alias("_s"),
        F.max(F.when(value.isNotNull(), F.struct(F.col(ts), stage.alias("stage"), value.alias("v")))).alias("_p"),
        at("add").alias("create_time"),
        at("start").alias("start_time"),
        at("complete").alias("end_time"),
    )
    return g.select(name, names[F.col("_s")["stage"]].alias("status"), F.col("_p")["v"].alias(pct), "create_time", "start_time", "end_time")


UNIT = 1_000_000  # progress is counted in millionths of a part


def parent_eta(log: DataFrame, timesteps: int, n_folds: int, name: str = "name", parent: str = "parent", ts: str = "ts",
               pct: str = "pct_complete") -> DataFrame:
    """D9 and D10 over a log: at every reading of a child, the progress of its parent (as ``progress``) and its
    ETA from the reading before, only where the step is more than one part of the total
    ``(timesteps + 1) * n_folds``.  Readings of one time are one step.  Progress is added up in whole
    ``UNIT``-ths of a part, so that the sums and the guard do not depend on the order of addition."""
    kind = _kind(F.col(name))
    weight = F.when(kind == "train", F.lit(float(timesteps))).when(kind == "validate", F.lit(1.0)).otherwise(F.lit(0.0))
    part = F.round(F.coalesce(F.col(pct), F.lit(0.0)) * weight * F.lit(float(UNIT))).cast("long")
    x = log.groupBy(name, parent, ts).agg(F.max(part).alias("_part"))
    x = blocked.rolling(x, [name], ts, 1, lambda w: {"_change": F.col("_part") - F.coalesce(F.lag("_part").over(w), F.lit(0))})
    steps = x.groupBy(parent, ts).agg(F.sum("_change").alias("_change"))
    steps = blocked.running(steps, [parent], ts, {"_done": ("sum", "_change")})
    steps = steps.withColumn(pct, F.col("_done") / F.lit(float((timesteps + 1) * n_folds * UNIT)))
    return eta(steps, parent, ts, pct, exact=("_done", UNIT))
