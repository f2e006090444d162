"""Operations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Service limits and retention.
COOLDOWN_MINUTES = 60
DAILY_BUDGET = 25.0
MAX_CONCURRENT = 1
RETENTION_DAYS = {"screenshots": 90, "reports": 365}
FORMATS = {"screenshot": "screenshots", "json": "data", "fix_plan": "data"}


def recent_scan(requests: DataFrame, jobs: DataFrame, minutes: int = COOLDOWN_MINUTES) -> DataFrame:
    """O1: as-of join: newest finished scan of the same url at most an hour before the request.

    Time is cut into buckets of the cooldown; a request looks into its own bucket and the one before, and each
    bucket is an equality key, so one popular url is spread over its buckets and no pair list is built per url.
    """
    size = minutes * 60
    done = jobs.where("status = 'done' and finished_at is not null").select("url", F.col("id").alias("job_id"), "finished_at", F.expr(f"cast(floor(unix_micros(cast(finished_at as timestamp)) / 1000000D / {size}) as bigint)").alias("bucket"))
    req = requests.withColumn("bucket", F.expr(f"cast(floor(unix_micros(cast(requested_at as timestamp)) / 1000000D / {size}) as bigint)"))
    # union both sides and carry the newest finish forward inside (url, bucket)
    marks = done.selectExpr("url", "bucket", "finished_at as at", "named_struct('finished_at', cast(finished_at as timestamp), 'job_id', job_id) as job", "0 as kind", "cast(null as bigint) as request_id")
    asks = req.selectExpr("url", "bucket", "requested_at as at", "cast(null as struct<finished_at:timestamp,job_id:bigint>) as job", "1 as kind", "request_id")
    w = W.partitionBy("url", "bucket").orderBy("at", "kind", "job.job_id").rowsBetween(W.unboundedPreceding, 0)
    here = marks.unionByName(asks).withColumn("found", F.last("job", ignorenulls=True).over(w)).where("kind = 1").select("request_id", "url", F.col("at").alias("requested_at"), "bucket", F.col("found").alias("here"))
    tails = done.groupBy("url", "bucket").agg(F.expr("max(named_struct('finished_at', cast(finished_at as timestamp), 'job_id', job_id))").alias("before")).withColumn("bucket", F.col("bucket") + 1)
    both = here.join(tails, ["url", "bucket"], "left").withColumn("j", F.coalesce("here", "before"))
    fresh = f"j.finished_at >= cast(requested_at as timestamp) - interval {minutes} minutes"
    return both.selectExpr("request_id", "url", "requested_at", f"if({fresh}, j.job_id, null) as reuse_job", f"if({fresh}, j.finished_at, null) as reuse_finished_at")


def daily_spend(jobs: DataFrame, cap: float = DAILY_BUDGET) -> DataFrame:
    """O2: spend per UTC day and what a new scan may still use."""
    return (
        jobs.groupBy(F.window("started_at", "1 day").alias("w"))
        .agg(F.sum("cost").alias("spent"), F.count(F.lit(1)).alias("scans"))
        .selectExpr("w.start as day", "scans", "spent", f"greatest(0.5D, {cap}D - spent) as remaining", f"spent >= {cap}D as exhausted")
    )


def active_scans(jobs: DataFrame, max_concurrent: int = MAX_CONCURRENT, hours: int = 1) -> DataFrame:
    """O3: how many scans run at each start, from +1/-1 events.

    The running sum is cut into time buckets: counts per bucket are small (one row per hour), their running sum
    gives each bucket its opening level, and only the rest of the sum runs inside one bucket at a time.
    """
    ev = jobs.selectExpr("started_at as at", "1 as step", "id").unionByName(jobs.where("finished_at is not null").selectExpr("finished_at as at", "-1 as step", "cast(null as bigint) as id"))
    ev = ev.withColumn("bucket", F.expr(f"cast(floor(unix_micros(cast(at as timestamp)) / 1000000D / {hours * 3600}) as bigint)"))
    per = ev.groupBy("bucket").agg(F.sum("step").alias("net"))
    opening = per.withColumn("opening", F.coalesce(F.sum("net").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("bucket", "opening")
    # at equal times an end comes before a start
    w = W.partitionBy("bucket").orderBy("at", "step", "id").rowsBetween(W.unboundedPreceding, 0)
    run = ev.withColumn("within", F.sum("step").over(w)).join(opening, "bucket")
    return run.where("step = 1").selectExpr("id", "at as started_at", "opening + within as active", f"opening + within > {max_concurrent} as over_cap")


def admission(requests: DataFrame) -> DataFrame:
    """Reuse, then busy, then budget, then accept. Needs ``reuse_job, active, spent``."""
    return requests.withColumn(
        "decision",
        F.expr(
            f"case when reuse_job is not null then 'reuse' when active >= {MAX_CONCURRENT} then 'busy' when spent >= {DAILY_BUDGET}D then 'budget' else 'accept' end"
        ),
    )


def clamp(value: str, lo: str, hi: str, fallback: str) -> str:
    """A missing or non-finite number becomes the fallback, anything else is held inside the range."""
    return f"if({value} is null or isnan({value}) or abs({value}) = double('infinity'), {fallback}, least({hi}, greatest({lo}, {value})))"


def scan_options(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {
            "max_pages_used": F.expr(clamp("cast(max_pages as double)", "1D", "2000D", "50D")),
            "max_depth_used": F.expr(clamp("cast(max_depth as double)", "0D", "20D", "5D")),
            "budget_used": F.expr(f"least({clamp('budget', '0.5D', '500D', '10D')}, greatest(0.5D, {DAILY_BUDGET}D - spent))"),
        }
    )


def run_history(runs: DataFrame, k: int) -> DataFrame:
    """Newest runs per project and status."""
    w = W.partitionBy("project_id", "status").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def visible_rows(rows: DataFrame, members: DataFrame, user_id: int | str) -> DataFrame:
    """Rows of the workspaces a user belongs to."""
    mine = members.where(F.col("user_id") == F.lit(user_id)).select("workspace_id")
    return rows.join(mine, "workspace_id", "left_semi")


def isolation_check(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows each user can see, and whether any of them also belongs to another workspace.

    Counts per workspace meet the memberships; rows are never paired with the users who may see them.
    """
    shared = rows.groupBy("row_id").agg(F.min("workspace_id").alias("lo"), F.max("workspace_id").alias("hi")).where("lo <> hi").select("row_id", F.lit(1).alias("shared"))
    sizes = rows.join(shared, "row_id", "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.count("shared").alias("shared"))
    m = members.select("user_id", "workspace_id").distinct()
    return m.join(sizes, "workspace_id").groupBy("user_id").agg(F.sum("n").alias("visible"), (F.sum("shared") > 0).alias("leak"))


CONSTRAINTS = {
    "domain is lower case without slash or colon": "domain is null or (domain = lower(domain) and not domain rlike '[/:]')",
    "name has 1 to 120 characters": "char_length(name) between 1 and 120",
    "pages between 1 and 2000": "requested_pages between 1 and 2000",
    "cost is not negative": "cost is null or cost >= 0",
    "role is known": "role in ('owner', 'member', 'viewer')",
}


def constraint_audit(rows: DataFrame, unique: list[str]) -> DataFrame:
    """Violations per constraint, one pass for the row checks and one aggregate for uniqueness."""
    items = ", ".join(f"'{name}', count_if(not coalesce({cond}, false))" for name, cond in CONSTRAINTS.items())
    checks = rows.selectExpr(f"map({items}) as m").selectExpr("explode(m) as (rule, violations)")
    dup = rows.groupBy(*unique).count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).selectExpr(f"'unique {' '.join(unique)}' as rule", "violations")
    return checks.unionByName(dup)


def artifact_prefix(fmt: str) -> str:
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in FORMATS.items())
    return f"coalesce(map({pairs})[{fmt}], 'reports')"


def artifact_key(run_id: str, fmt: str, filename: str) -> str:
    """Key by retention prefix, then run; names can neither leave their folder nor hide."""
    safe = rf"left(regexp_replace(regexp_replace(regexp_replace({filename}, r'[^a-zA-Z0-9._-]', '_'), r'[.]{{2,}}', '.'), r'^[.\-_]+', ''), 120)"
    return f"concat({artifact_prefix(fmt)}, '/', {run_id}, '/', coalesce(nullif({safe}, ''), 'artifact'))"


def retention(artifacts: DataFrame, now: str, notice_days: int = 14) -> DataFrame:
    """When each artifact expires and whether its owner must be told."""
    days = "case prefix " + " ".join(f"when '{k}' then {v}" for k, v in RETENTION_DAYS.items()) + " end"
    df = artifacts.withColumn("prefix", F.expr(artifact_prefix("format"))).withColumn("expires_on", F.expr(f"date_add(cast(created_at as date), {days})"))
    return df.withColumn("expired", F.expr(f"coalesce(expires_on <= {now}, false)")).withColumn(
        "expiring_soon", F.expr(f"coalesce(expires_on > {now} and expires_on <= date_add({now}, {notice_days}), false)")
    )


def without_runs(artifacts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Everything of a deleted run goes; with partitioned storage this drops whole folders."""
    return artifacts.join(deleted.select("run_id").distinct(), "run_id", "left_anti")


def upsert_claims(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest claim per (workspace, domain); an incoming one wins a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    cols = [c for c in both.columns if c not in ("workspace_id", "domain", "_new")]
    packed = F.expr("struct(" + ", ".join(cols) + ")")
    return both.groupBy("workspace_id", "domain").agg(F.max_by(packed, F.struct("_new", "claimed_at")).alias("r")).select("workspace_id", "domain", "r.*")


def capped_runs(runs: DataFrame) -> DataFrame:
    """Runs that covered fewer pages than asked for."""
    return runs.where("applied_pages < requested_pages").withColumn("missing_pages", F.expr("requested_pages - applied_pages"))
