"""digest(): everything that can be said of a table or of documents, and a narrative checked against it.

The facets stay DataFrames; only the assembled digest, whose size the limits bound, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from threading import Lock
from uuid import uuid4

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators import columns as C
from siftmill.operators import samples as S
from siftmill.operators import semantics as M
from siftmill.plans.steps import Steps

#: How sure a domain must be to be named, and how many columns' meanings are listed (fixed values).
NAMED_DOMAIN, MEANINGS = 0.6, 20


@dataclass
class TableDigest:
    """The facets of a table, each a DataFrame."""

    rows: DataFrame
    kinds: DataFrame
    missing: DataFrame
    distinct: DataFrame
    stats: DataFrame
    pairs: DataFrame
    outliers: DataFrame
    values: DataFrame
    categories: DataFrame
    roles: DataFrame
    domain: DataFrame
    kind: DataFrame
    spotlights: DataFrame
    sample: DataFrame | None


def table_digest(df: DataFrame, key: str | None = None) -> TableDigest:
    """All facets of df; its columns' kinds, their moments and the brackets of their ranks are computed at once, the
    others when they are used. key orders the samples."""
    kinds = C.column_kinds(df)
    categorical = [r.column for r in kinds.where("bucket = 'categorical'").orderBy("position").collect()]  # a row a column
    numeric = C.numeric_columns(df)
    names = M.names_of(df)
    stats = C.numeric_stats(df)
    ranked = C.most_varied(stats) if len(numeric) > C.CORRELATED else numeric
    return TableDigest(
        rows=C.duplicate_rows(df), kinds=kinds, missing=C.missing_values(df), distinct=C.distinct_values(df), stats=stats,
        pairs=C.correlations(df, ranked), outliers=C.outliers(df), values=C.category_values(df, categorical), categories=C.category_summary(df, categorical),
        roles=M.column_roles(names), domain=M.domain(names), kind=M.dataset_kind(names), spotlights=C.spotlights(df),
        sample=S.representative_sample(df, key) if key else None,
    )


def assembled(d: TableDigest) -> dict:
    """A digest as a dictionary, cut to the profile's limits."""
    rows = lambda df, *order: [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]
    size = d.rows.first()
    kinds = rows(d.kinds, "position")
    missing = rows(d.missing.where("missing > 0"), F.desc("missing"), "position")
    return {
        "dataset": {"rows": size["rows"], "columns": len(kinds), "duplicate_rows": size.duplicate_rows},
        "columns": [k["column"] for k in kinds],
        "column_categories": {r.bucket: r.listed for r in C.column_preview(d.kinds).collect()},
        "data_types": {b: sum(k["bucket"] == b for k in kinds) for b in ("numeric", "categorical", "text", "datetime", "boolean")},
        "quality": {"missing_values_total": sum(m["missing"] for m in missing), "missing_by_column": missing[: C.TOP_MISSING], "constant_columns": [r.column for r in d.distinct.where("is_constant").orderBy("position").collect()]},
        "unique_value_counts": {r.column: r.n_unique for r in d.distinct.where("n_unique > 1").collect()} if len(kinds) <= C.CORRELATED else {},
        "statistics": {"important_numeric_columns": rows(d.stats.where(F.col("rank") <= C.TOP_NUMERIC), "rank"), "extremes": rows(C.global_extremes(d.stats))},
        "correlations": {s: rows(C.strongest(d.pairs, s), "rank") for s in ("positive", "negative")},
        "outliers": rows(C.top_outliers(d.outliers), "rank"),
        "categorical_breakdown": rows(d.categories, "rank"),
        "top_values": rows(d.values, "position", "rank"),
        "spotlights": rows(d.spotlights, "position", "rank"),
        "semantics": rows(d.kind)[0],
        "domain": rows(d.domain)[0],
        "roles": rows(d.roles, "position"),
        "sample": rows(d.sample) if d.sample is not None else [],
    }


def statements(d: TableDigest) -> DataFrame:
    """(part, place, text): what the facets say, a sentence each. part is summary, finding, metric or
    anomaly; a facet without anything to say has no row."""
    n, kinds, missing = F.col("rows"), d.kinds, d.missing.where("missing > 0")

    def said(df: DataFrame, part: str, place: int, text) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.lit(place).alias("place"), text.alias("text")).where("text IS NOT NULL AND text != ''")

    def listed(df: DataFrame, part: str, place: int, lead: str, text, order: str = "rank") -> DataFrame:
        """One sentence that lists all rows of df, in order."""
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
        whole = df.agg(F.transform(rows, lambda x: x["t"]).alias("all")).where(F.size("all") > 0)
        return said(whole, part, place, F.concat(F.lit(lead), F.array_join("all", ", "), F.lit(".")))

    num = lambda c: F.col(c).cast("string")
    by_kind = kinds.groupBy("bucket").agg(F.count("*").alias("n"), F.min("position").alias("rank"))
    top = d.values.where("rank = 1")
    parts = [
        said(d.kind, "summary", 0, F.col("summary")),
        said(d.rows, "summary", 1, F.when(F.col("duplicate_rows") > 0, F.format_string("%d of its %d rows repeat another one.", "duplicate_rows", n)).otherwise(F.format_string("None of its %d rows repeats another one.", n))),
        listed(by_kind, "summary", 2, "By kind, its columns are: ", F.format_string("%d %s", "n", "bucket")),
        listed(missing, "summary", 3, "Values are missing in: ", F.format_string("%s (%d)", "column", "missing"), "position"),
        said(d.domain, "summary", 4, F.when((F.col("label") != "Unknown") & (F.col("confidence") >= NAMED_DOMAIN), F.concat(F.lit("Judging by names, the field is "), "label", F.lit(".")))),
        listed(d.stats.where("rank <= 3"), "finding", 0, "The numbers that vary most are ", F.concat("column", F.lit(" (mean "), num("mean"), F.lit(", from "), num("min"), F.lit(" to "), num("max"), F.lit(")"))),
        listed(C.strongest(d.pairs, "positive").where("value >= 0.5"), "finding", 1, "These rise together: ", F.concat("a", F.lit(" and "), "b", F.lit(" ("), num("value"), F.lit(")"))),
        listed(C.strongest(d.pairs, "negative").where("value <= -0.5"), "finding", 2, "One falls as the other rises: ", F.concat("a", F.lit(" and "), "b", F.lit(" ("), num("value"), F.lit(")"))),
        listed(top, "finding", 3, "The most common values are ", F.concat(F.col("value"), F.lit(" in "), "column", F.lit(" ("), num("count"), F.lit(")")), "position"),
        listed(d.spotlights.where("rank = 1"), "finding", 4, "Worth a look: ", F.concat("value", F.lit(" in "), "column"), "position"),
        listed(d.roles.where(f"position < {MEANINGS}"), "finding", 5, "What columns hold: ", F.concat("column", F.lit(" is a "), F.replace("role", F.lit("_"), F.lit(" "))), "position"),
        listed(C.top_outliers(d.outliers), "anomaly", 0, "Far from the middle half: ", F.concat(num("outliers"), F.lit(" values of "), "column")),
        listed(d.distinct.where("is_constant"), "anomaly", 1, "Of one value only: ", F.col("column"), "position"),
    ]
    return reduce(DataFrame.union, parts)


def narrated(d: TableDigest, profile: dict) -> dict:
    """A summary in words: the statements, part by part, and the profile's counts."""
    said: dict[str, list[str]] = {}
    for r in statements(d).orderBy("part", "place").collect():  # a row for each sentence
        said.setdefault(r.part, []).append(r.text)
    size, types = profile["dataset"], profile["data_types"]
    counts = {f"{k}_columns": types[k] for k in ("numeric", "categorical") if k in types}
    return {
        "title": f"{profile['semantics']['kind']} table of {size['rows']} rows by {size['columns']} columns",
        "executive_summary": " ".join(said.get("summary", [])), "key_findings": said.get("finding", []),
        "calculated_metrics": {"row_count": size["rows"], "column_count": size["columns"], "missing_values_total": profile["quality"]["missing_values_total"], "dataset_kind": profile["semantics"]["kind"], **counts},
        "anomalies_detected": said.get("anomaly", []), "recommendations": [],
    }


def digest(df: DataFrame, key: str | None = None, steps: Steps | None = None) -> dict:
    """{profile, summary} of a table. steps: takes the time of each step, and the rows and nulls that it saw."""
    steps = steps or Steps()
    with steps.step("facets") as watch:
        facets = table_digest(watch("table", df), key)
    with steps.step("profile"):
        profile = assembled(facets)
    with steps.step("narrative"):
        summary = narrated(facets, profile)
    return {"profile": profile, "summary": summary}


@dataclass
class Job:
    id: str
    status: str = "queued"
    result: object = None
    error: str | None = None
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


class Jobs:
    """Digests in the background: each runs under a tag of its own, so that it can be cancelled."""

    def __init__(self, spark: SparkSession, workers: int = 2):
        self.spark, self.held, self.lock = spark, {}, Lock()
        self.pool = ThreadPoolExecutor(workers)

    def submit(self, work: Callable[[], object]) -> str:
        job = Job(uuid4().hex)
        with self.lock:
            self.held[job.id] = job

        def run() -> None:
            if job.status == "cancelled":
                return
            job.status = "running"
            self.spark.addTag(job.id)
            try:
                job.result = work()
                job.status = "done" if job.status == "running" else job.status
            except Exception as e:
                job.error = str(e)
                job.status = "failed" if job.status == "running" else job.status
            finally:
                self.spark.removeTag(job.id)

        def inherited() -> None:
            thread = InheritableThread(target=run)
            thread.start()
            thread.join()

        self.pool.submit(inherited)
        return job.id

    def get(self, job_id: str) -> Job | None:
        return self.held.get(job_id)

    def cancel(self, job_id: str) -> None:
        self.held[job_id].status = "cancelled"
        self.spark.interruptTag(job_id)

    def counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for job in list(self.held.values()):
            out[job.status] = out.get(job.status, 0) + 1
        return out
