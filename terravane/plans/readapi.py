"""Read-side queries over scores and features."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators import scoring

# fixed values
LABELS = {
    "sub_power": "Power redundancy",
    "sub_water": "Water proximity",
    "sub_conn": "Connectivity (fiber)",
    "sub_solar": "Solar potential",
    "sub_clim": "Climate (cool)",
    "sub_lat": "Demand latency",
}


def score_map(scores: DataFrame, run_id=None, state: str | None = None, min_score: float | None = None, limit: int | None = None) -> DataFrame:
    out = scores.filter(~F.col("is_excluded"))
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if state:
        out = out.filter(F.col("state_code") == state)
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    out = out.select("cell_id", "state_code", "score", "lon", "lat")
    return out.orderBy(F.desc("score"), "cell_id").limit(limit) if limit else out


def state_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("state_code").agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
        F.percentile("score", F.lit(0.9)).alias("p90_score"),
        F.count_if(F.col("score") >= 0.7).alias("n_high"),
        F.count_if("is_excluded").alias("n_excluded"),
    )


def histogram(scores: DataFrame, buckets: int = 30) -> DataFrame:
    """Equal buckets over 0..1; a score of 1 is in bucket buckets + 1."""
    b = F.expr(f"width_bucket(score, 0, 1, {buckets})").alias("bucket")
    return scores.filter("score is not null").groupBy(b).agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def kpis(scores: DataFrame) -> DataFrame:
    n, out = F.count("*"), F.count_if("is_excluded")
    return scores.agg(
        n.alias("cells"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best"),
        F.lit(quantile(scores, "score", 0.9) or 0.0).alias("p90"),
        F.coalesce(out / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("excluded_share"),
    )


def breakdown_json(subs: list[str]) -> Column:
    return F.to_json(F.struct(*subs))


def ranked_parts(breakdown: Column) -> Column:
    """(label, value) pairs of a JSON breakdown, greatest first; malformed text and other values give none."""
    pairs = F.map_entries(F.from_json(breakdown, "map<string,string>"))
    typed = F.transform(pairs, lambda e: F.struct((-e["value"].try_cast("double")).alias("v"), e["key"].alias("k")))
    kept = F.array_sort(F.filter(typed, lambda e: e["v"].isNotNull()))
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.transform(kept, lambda e: F.struct(F.coalesce(names[e["k"]], e["k"]).alias("label"), (-e["v"]).alias("value"))), F.array().cast("array<struct<label:string,value:double>>"))


def reasoning(score: Column, parts: Column) -> Column:
    """A sentence: the two strongest parts, and the weakest if it is under 0.4 and there are three or more."""
    say = lambda p: F.format_string("%s %.2f", F.lower(p["label"]), p["value"])
    top = F.array_join(F.transform(F.slice(parts, 1, 2), say), " and ")
    low = F.get(parts, F.size(parts) - 1)
    weak = F.when((F.size(parts) > 2) & (low["value"] < 0.4), F.concat(F.lit("; weakest: "), say(low))).otherwise("")
    full = F.concat(F.format_string("Score %.3f, led by ", score), top, weak, F.lit("."))
    return F.when(F.size(parts) == 0, F.format_string("Score %.3f.", score)).otherwise(full)


def eta_text(seconds: Column) -> Column:
    """Seconds as text: whole seconds under a minute, minutes under an hour, else hours."""
    # fixed values: the three formats
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).when(seconds < 3600, F.format_string("%.1fmin", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def list_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """The latest runs first."""
    return runs.orderBy(F.desc_nulls_last("finished_at"), F.desc("run_id")).limit(limit)


def latest_run_id(runs: DataFrame):
    row = runs.filter("status = 'success'").orderBy(F.desc_nulls_last("finished_at"), F.desc("run_id")).first()
    return row and row.run_id


def list_states(scores: DataFrame) -> DataFrame:
    return scores.select("state_code").filter("state_code is not null").distinct().orderBy("state_code")


def top_sites(sites: DataFrame, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Sites by state, the best first."""
    out = sites.filter(F.col("state_code") == state) if state else sites
    out = out.orderBy("state_code", F.desc("score"), "cell_id")
    return out.limit(limit) if limit else out


def cell_detail(features: DataFrame, scores: DataFrame, runs: DataFrame, cell_id) -> DataFrame:
    """A cell's features with its score of the latest run by time; the score is NULL if it has none."""
    own = scores.filter(F.col("cell_id") == cell_id).join(runs.select("run_id", "finished_at"), "run_id")
    last = own.orderBy(F.desc_nulls_last("finished_at"), F.desc("run_id")).limit(1).select("cell_id", "run_id", "score")
    return features.filter(F.col("cell_id") == cell_id).join(last, "cell_id", "left")


def rescore(features: DataFrame, preset, **changes) -> DataFrame:
    """Scores of the features under a preset with some of its values changed, best first."""
    out = scoring.score(features, dataclasses.replace(preset, **changes))
    return out.select("cell_id", "state_code", *scoring.SUBS, "score").orderBy(F.desc("score"), "cell_id")


def quantile(df: DataFrame, column: str, q: float, buckets: int = 10_000) -> float | None:
    """The exact quantile with linear interpolation, without gathering the column in one task.

    Rows are counted in equal buckets between the extremes; only the values of the buckets that hold the two ranks are
    then counted one by one. Equal values are one row, so a hot value is no burden.
    """
    c = F.col(column)
    rows = df.select(c.cast("double").alias("v")).filter("v is not null")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    if low == high:
        return low
    width = (high - low) / buckets
    own = F.least(F.floor((F.col("v") - low) / width), F.lit(buckets - 1)).alias("b")
    counts = sorted((r.b, r.n) for r in rows.groupBy(own).agg(F.count("*").alias("n")).collect())  # at most buckets rows
    rank = q * (n - 1)
    want, found, seen = {int(rank), min(n - 1, int(rank) + 1)}, {}, 0
    for b, m in counts:
        inside = [k for k in want if seen <= k < seen + m]
        if inside:
            at = seen
            for r in rows.filter(own == b).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").toLocalIterator():
                found.update({k: r.v for k in inside if at <= k < at + r.n})
                at += r.n
                if all(k in found for k in inside):
                    break
        seen += m
    a, z = found[int(rank)], found[min(n - 1, int(rank) + 1)]
    return a + (rank - int(rank)) * (z - a)


def compare(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row per cell and named value."""
    return features.unpivot(["cell_id"], columns, "name", "value")


def staleness(runs: DataFrame, now: str, days: int = 14) -> DataFrame:
    last = runs.filter("status = 'success'").groupBy("source").agg(F.max("finished_at").alias("last"))
    age = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(F.col("last").cast("timestamp"))) / 8.64e10
    return last.select("source", age.alias("age_days")).withColumn("stale", F.col("age_days") > days)
