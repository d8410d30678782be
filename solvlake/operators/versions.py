"""Version resolution, browsing, and duplicate lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvlake.functions.text import canonical_doi


def best_runs(runs: DataFrame, paper: str = "paper_id", order: tuple[Column | str, ...] = (), approved: Column | None = None) -> DataFrame:
    """The latest approved run of each paper. Versions compare as text; NULLs come last."""
    keys = order or (F.desc("prompt_version"), F.desc("reviewed_at"), F.desc("prompt_run_id"))
    ok = (F.col("status") == "approved") if approved is None else approved
    ranked = runs.filter(ok).withColumn("_rank", F.row_number().over(Window.partitionBy(paper).orderBy(*keys)))
    return ranked.filter("_rank = 1").drop("_rank")


def current_best(rows: DataFrame, runs: DataFrame, run: str = "prompt_run_id", **how) -> DataFrame:
    """The rows of the best run of each paper."""
    return rows.join(best_runs(runs, **how).select(run), run, "left_semi")


def latest_status(events: DataFrame, run: str = "prompt_run_id", at: str = "event_id") -> DataFrame:
    """Status is appended, not updated: the last event of each run holds."""
    return events.groupBy(run).agg(F.max_by(F.struct(*[c for c in events.columns if c != run]), at).alias("e")).select(run, "e.*")


def paper_list(papers: DataFrame, approved: DataFrame, best: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Papers with how many approved runs and current rows they have, 0 where none."""
    runs = approved.groupBy(paper).agg(F.count("*").alias("approved_runs"))
    rows = best.groupBy(paper).agg(F.count("*").alias("current_best_rows"))
    counted = papers.join(runs, paper, "left").join(rows, paper, "left")
    return counted.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("approved_runs", "current_best_rows")})


def history(events: DataFrame, papers: DataFrame, newest: str, paper: str = "paper_id", only: int | None = None) -> DataFrame:
    """Runs or reviews with their paper's columns, newest first, of one paper if asked."""
    some = events if only is None else events.filter(F.col(paper) == only)
    return some.join(papers, paper).orderBy(F.desc(newest))


def find_duplicates(incoming: DataFrame, known: DataFrame, sha: str = "content_sha256", doi: str = "doi", paper: str = "paper_id") -> DataFrame:
    """incoming with paper_id and reason: by content hash first, by DOI otherwise; NULL if new."""
    by_hash = known.groupBy(sha).agg(F.min(paper).alias("_by_hash"))
    by_doi = known.withColumn("_doi", canonical_doi(F.col(doi))).filter("_doi IS NOT NULL").groupBy("_doi").agg(F.min(paper).alias("_by_doi"))
    told = incoming.withColumn("_doi", canonical_doi(F.col(doi))).join(by_hash, sha, "left").join(by_doi, "_doi", "left")
    reason = F.when(F.col("_by_hash").isNotNull(), "content_hash").when(F.col("_by_doi").isNotNull(), "doi")
    return told.withColumn("match_id", F.coalesce("_by_hash", "_by_doi")).withColumn("reason", reason).drop("_doi", "_by_hash", "_by_doi")


def lookup(papers: DataFrame, content_sha256: str | None = None, doi: str | None = None, paper_id: int | None = None) -> DataFrame:
    """The paper with a hash, a DOI (in any case, trimmed) or an id, the first if there are several. A blank DOI finds none."""
    if content_sha256 is not None:
        found = papers.filter(F.col("content_sha256") == content_sha256)
    elif paper_id is not None:
        found = papers.filter(F.col("paper_id") == paper_id)
    else:
        found = papers.filter(canonical_doi(F.col("doi")) == F.nullif(F.lit((doi or "").strip().lower()), F.lit("")))
    return found.orderBy("paper_id").limit(1)


def totals(papers: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: papers, approved runs, current rows."""
    each = [papers.select(F.lit(0).alias("kind")), runs.filter("status = 'approved'").select(F.lit(1).alias("kind")), rows.select(F.lit(2).alias("kind"))]
    return reduce(DataFrame.unionByName, each).agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in enumerate(("papers", "approved", "n_rows"))])


def included_rows(df: DataFrame, column: str, chosen: list) -> DataFrame:
    """Rows with one of the chosen values; all rows if none is chosen."""
    return df.filter(F.col(column).isin(chosen)) if chosen else df


def usage_sums(calls: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """keys, calls, and the sum of each count over a chain of calls."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), *[F.sum(c).alias(n) for n, c in counts.items()])


def first_known(rows: DataFrame, keys: list[str], value: Column, ordinal: str, name: str) -> DataFrame:
    """keys and the first value that is not NULL, by the ordinal."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.when(value.isNotNull(), F.col(ordinal))).alias(name))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two frames hold the same rows as often; an edited frame does not."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def approval_note(note: Column, override: Column, passed: Column) -> Column:
    """Notes of approvals in spite of red flags say so."""
    return F.when(override & ~passed, F.concat(F.lit("[RED-flag override] "), F.coalesce(note, F.lit("no reason given")))).otherwise(note)
