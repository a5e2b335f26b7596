"""Queries for job hierarchies and job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsfolds.operators import jobs
from tsfolds.plans import fixtures as fx
from tsfolds.plans.fixtures import with_views
from tsfolds.plans.queries import query, v
from tsfolds.sources import store

TIMESTEPS = 1000

STATE_SQL = """s as (select name, max(struct_pack(ts := ts, p := pct_complete)) as last_, min(ts) as start_time
      from job_log group by name),
st as (select name, last_.p as pct_complete, last_.ts as update_time, start_time,
              case when last_.p >= 1.0 then 'complete' when last_.p > 0 then 'running' else 'pending' end as status from s)"""


def _state(spark, sf_dir):
    return jobs.current_state(v(spark, sf_dir, "job_log"))


@query("c6_workers_of", with_views("""select w.*, j.parent as job_parent from workers w join jobs j on w.jobname = j.name""",
                                   "workers", "jobs"))
def c6_workers_of(spark, sf_dir):
    """Workers with their job (inner join)."""
    return jobs.workers_of(v(spark, sf_dir, "workers"), v(spark, sf_dir, "jobs"))


@query("c7_orphans", with_views("""select * from workers w where not exists (select 1 from jobs j where j.name = w.jobname)""",
                                "workers", "jobs"))
def c7_orphans(spark, sf_dir):
    """Workers whose job does not exist."""
    return jobs.orphans(v(spark, sf_dir, "workers"), v(spark, sf_dir, "jobs"))


@query("c8_delete_where", with_views(f""", {STATE_SQL}
select * from job_log where name not in (select name from st where status = 'complete')""", "job_log"))
def c8_delete_where(spark, sf_dir):
    """The progress log without the rows of completed jobs (anti-join on
    the key set)."""
    done = _state(spark, sf_dir).where(F.col("status") == "complete").select("name")
    return store.delete_where(v(spark, sf_dir, "job_log"), done, "name")


@query("d7_workers_csv", with_views("select jobname, string_agg(name, ',' order by name) as workers from workers group by jobname",
                                    "workers"))
def d7_workers_csv(spark, sf_dir):
    """Comma-joined worker names per job."""
    return jobs.workers_csv(v(spark, sf_dir, "workers"))


@query("d8_worker_map", with_views("select jobname, list(name order by name) as workers from workers group by jobname", "workers"))
def d8_worker_map(spark, sf_dir):
    """Job -> sorted list of workers."""
    m = jobs.worker_map(v(spark, sf_dir, "workers"))
    return m.withColumn("workers", F.transform("workers", lambda x: F.when(x.isNotNull(), x)))  # nullable elements, as SQL lists


@query("d9_progress", with_views(f""", {STATE_SQL}
select split_part(name, '.', 1) as parent, count(distinct split_part(name, '.', 3)) as folds,
  round(sum(case when split_part(name, '.', 2) = 'train' then pct_complete * {TIMESTEPS}.0
                 when split_part(name, '.', 2) = 'validate' then pct_complete end)
        / ({TIMESTEPS + 1}.0 * count(distinct split_part(name, '.', 3))), 6) + 0.0 as pct_complete
from st group by split_part(name, '.', 1)""", "job_log"))
def d9_progress(spark, sf_dir):
    """Weighted progress roll-up of each parent job from its children."""
    s = _state(spark, sf_dir).withColumn("parent", F.split("name", r"\.")[0])
    return jobs.progress(s, TIMESTEPS)


@query("d10_eta", with_views(""", x as (select name, ts, pct_complete, epoch_us(ts) as us,
        epoch_us(ts) - lag(epoch_us(ts)) over w as dt_us, pct_complete - lag(pct_complete) over w as delta
      from job_log window w as (partition by name order by ts)),
y as (select *, case when delta > 0 then dt_us / 1e6 / delta * (1.0 - pct_complete) end as secs from x)
select name, ts, round(pct_complete, 6) + 0.0 as pct_complete, round(delta, 6) + 0.0 as delta, round(secs, 6) + 0.0 as eta_secs,
  case when delta > 0 then make_timestamp(us + cast(floor(secs * 1e6) as bigint)) end as eta from y""", "job_log"))
def d10_eta(spark, sf_dir):
    """ETA of each reading from the previous reading of the same job."""
    return jobs.eta(v(spark, sf_dir, "job_log"))


@query("i1_descendants", with_views("""select * from (with recursive r(name, parent, level) as (
  select name, parent, 1 from jobs where parent = 'AMERICA'
  union all select j.name, j.parent, r.level + 1 from jobs j join r on j.parent = r.name) select * from r)""", "jobs"))
def i1_descendants(spark, sf_dir):
    """All descendants of a region with their depth."""
    return jobs.descendants(v(spark, sf_dir, "jobs"), "AMERICA")


@query("i2_delete_subtree", with_views("""select * from jobs where name <> 'ASIA' and name not in (
  with recursive r(name) as (select name from jobs where parent = 'ASIA'
    union all select j.name from jobs j join r on j.parent = r.name) select name from r)""", "jobs"))
def i2_delete_subtree(spark, sf_dir):
    """The job table without a region and its subtree."""
    return jobs.delete_subtree(v(spark, sf_dir, "jobs"), "ASIA")


@query("i3_tree_paths", with_views("""select * from (with recursive r(name, path, depth) as (
  select name, name, 0 from jobs where parent is null
  union all select j.name, r.path || '/' || j.name, r.depth + 1 from jobs j join r on j.parent = r.name) select * from r)""", "jobs"))
def i3_tree_paths(spark, sf_dir):
    """Every job with its path from the root."""
    return jobs.paths(v(spark, sf_dir, "jobs"))


@query("i4_levels", with_views("""select node, cast(max(level) as integer) as level, false as in_cycle from (
  with recursive r(node, level) as (select name, 0 from jobs where parent is null
    union all select j.name, r.level + 1 from jobs j join r on j.parent = r.node) select * from r) group by node""", "jobs"))
def i4_levels(spark, sf_dir):
    """I4: dependency level of every job node (cycles reported)."""
    return jobs.levels(v(spark, sf_dir, "jobs"), "parent", "name")


@query("i1_descendants_deep", with_views("""select * from (with recursive r(name, parent, level) as (
  select name, parent, 1 from deep_jobs where parent = 'NATION_7'
  union all select j.name, j.parent, r.level + 1 from deep_jobs j join r on j.parent = r.name) select * from r)""", "deep_jobs"))
def i1_descendants_deep(spark, sf_dir):
    """I1 over trees whose depth grows with the data."""
    return jobs.descendants(v(spark, sf_dir, "deep_jobs"), "NATION_7")


@query("i2_delete_subtree_deep", with_views("""select * from deep_jobs where name <> 'NATION_11' and name not in (
  with recursive r(name) as (select name from deep_jobs where parent = 'NATION_11'
    union all select j.name from deep_jobs j join r on j.parent = r.name) select name from r)""", "deep_jobs"))
def i2_delete_subtree_deep(spark, sf_dir):
    """I2 over trees whose depth grows with the data."""
    return jobs.delete_subtree(v(spark, sf_dir, "deep_jobs"), "NATION_11")


@query("i4_levels_deep", with_views("""select node, cast(max(level) as integer) as level, false as in_cycle from (
  with recursive r(node, level) as (select name, 0 from deep_jobs where parent is null
    union all select j.name, r.level + 1 from deep_jobs j join r on j.parent = r.node) select * from r) group by node""", "deep_jobs"))
def i4_levels_deep(spark, sf_dir):
    """I4 over trees whose depth grows with the data."""
    return jobs.levels(v(spark, sf_dir, "deep_jobs"), "parent", "name")


# the walk's order is that of the paths, compared name by name; a subtree is the paths that begin with its root's
TREE_SQL = """, t as (select * from (with recursive r(name, parent, path, depth) as (
    select name, parent, [name], 0 from deep_jobs where parent is null
    union all select j.name, j.parent, list_append(r.path, j.name), r.depth + 1 from deep_jobs j join r on j.parent = r.name) select * from r)),
z as (select top, count(*) as size from (select unnest(path) as top from t) group by top),
ix as (select t.name, t.parent, t.depth, row_number() over (order by t.path) - 1 as pre, z.size, t.path from t join z on t.name = z.top)"""


@query("i3_tree_index", with_views(TREE_SQL + """
select name, parent, depth, pre, pre + size - 1 as post, size from ix""", "deep_jobs"))
def i3_tree_index(spark, sf_dir):
    """The job trees as pre-order intervals."""
    return jobs.tree_index(v(spark, sf_dir, "deep_jobs"))


@query("i3_subtree_range", with_views(TREE_SQL + """
select name, parent, depth, pre, pre + size - 1 as post, size from ix where list_contains(path, 'NATION_3')""", "deep_jobs"))
def i3_subtree_range(spark, sf_dir):
    """One subtree as a range of the tree index."""
    return jobs.subtree(jobs.tree_index(v(spark, sf_dir, "deep_jobs")), "NATION_3")


@query("i5_current_state", with_views(f""", {STATE_SQL}
select name, round(pct_complete, 6) + 0.0 as pct_complete, update_time, start_time, status from st""", "job_log"))
def i5_current_state(spark, sf_dir):
    """Current state of every job from the append-only log."""
    return _state(spark, sf_dir)


@query("i6_status", with_views(f""", {STATE_SQL}
select name, round(pct_complete, 6) + 0.0 as pct_complete, update_time, start_time, status from st
where status = 'complete' and name in ('job0.train.0', 'job0.train.1', 'job1.validate.2', 'job2.train.3')""", "job_log"))
def i6_status(spark, sf_dir):
    """Status lookup by names and status."""
    return jobs.status(_state(spark, sf_dir), ["job0.train.0", "job0.train.1", "job1.validate.2", "job2.train.3"], ["complete"])


@query("i7_table_names", with_views("select distinct parent from job_log", "job_log"))
def i7_table_names(spark, sf_dir):
    """Distinct names (the parents present in the log)."""
    return store.table_names(v(spark, sf_dir, "job_log"), "parent")


@query("i8_fold_jobs", with_views("""select r.run || '.' || k.kind || '.' || cast(f.fold as varchar) as name, r.run as parent,
  k.kind, cast(f.fold as integer) as fold
from (select distinct parent as run from job_log) r, (values ('train'), ('validate')) k(kind), range(0, 4) f(fold)""", "job_log"))
def i8_fold_jobs(spark, sf_dir):
    """I8: the train / validate child jobs of every run (4 folds)."""
    runs = v(spark, sf_dir, "job_log").select(F.col("parent").alias("run")).distinct()
    return jobs.fold_jobs(runs, 4)


EVENTS_SQL = """, ev as (select 'job' || (user_id % 200) as name, ts,
    case when value > 90 then 'complete' when value < 10 then 'start' when value < 15 then 'add' else 'progress' end as event,
    round(value / 100, 4) as pct_complete from events),
sg as (select *, case event when 'add' then 0 when 'start' then 1 when 'complete' then 3 else 2 end as stage,
    case event when 'add' then 0.0 when 'complete' then 1.0 when 'progress' then pct_complete end as val from ev)"""


@query("i5_event_state", f"""with dummy as (select 1){EVENTS_SQL}
select name, case max(case when event <> 'progress' then struct_pack(t := ts, s := stage) end).s when 0 then 'pending' when 1 then 'running'
    when 3 then 'complete' end as status,
  round(max(case when val is not null then struct_pack(t := ts, s := stage, v := val) end).v, 6) + 0.0 as pct_complete,
  max(case when event = 'add' then ts end) as create_time, max(case when event = 'start' then ts end) as start_time,
  max(case when event = 'complete' then ts end) as end_time
from sg group by name""")
def i5_event_state(spark, sf_dir):
    """I5 from job events (add, start, progress, complete) read off the event table."""
    e = fx.table(spark, sf_dir, "events")
    value = F.col("value")
    event = F.when(value > 90, "complete").when(value < 10, "start").when(value < 15, "add").otherwise("progress")
    log = e.select(
        F.concat(F.lit("job"), (F.col("user_id") % 200).cast("string")).alias("name"), "ts", event.alias("event"), F.round(value / 100, 4).alias("pct_complete")
    )
    return jobs.event_state(log)


@query("d10_parent_eta", with_views(f""", p as (select name, parent, ts, max(cast(round(coalesce(pct_complete, 0) * case split_part(name, '.', 2)
    when 'train' then {TIMESTEPS}.0 when 'validate' then 1.0 else 0.0 end * 1000000.0) as bigint)) as part from job_log group by name, parent, ts),
c as (select *, part - coalesce(lag(part) over (partition by name order by ts), 0) as change from p),
t as (select parent, ts, sum(change) as change from c group by parent, ts),
d as (select parent, ts, sum(change) over (partition by parent order by ts) as done from t),
f as (select *, done / ({TIMESTEPS + 1}.0 * 4 * 1000000.0) as pct from d),
e as (select *, done - lag(done) over w as step, pct - lag(pct) over w as delta, epoch_us(ts) - lag(epoch_us(ts)) over w as dt_us
      from f window w as (partition by parent order by ts))
select parent, ts, round(pct, 6) + 0.0 as pct_complete, round(delta, 6) + 0.0 as delta,
  round(case when step > 1000000 then dt_us / 1e6 / delta * (1 - pct) end, 3) + 0.0 as eta_secs from e""", "job_log"))
def d10_parent_eta(spark, sf_dir):
    """D9 + D10: progress and guarded ETA of every parent at each reading of its children."""
    x = jobs.parent_eta(v(spark, sf_dir, "job_log"), TIMESTEPS, 4)
    return x.select("parent", "ts", "pct_complete", "delta", F.round("eta_secs", 3).alias("eta_secs"))
