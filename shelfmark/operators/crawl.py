"""Crawling over stored pages: link graph, frontier steps, resumption and status."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..session import checkpointed


def outlinks(pages: DataFrame, url: str = "url", html: str = "html", scope: str | None = None) -> DataFrame:
    """``(referrer, pos, url)``: absolute, normalised links of every page, in page order; links out of scope are dropped."""
    found = pages.select(urls.base_parts(F.col(url)).alias("base"), F.posexplode(urls.links(F.col(html))).alias("pos", "link"))
    out = found.select(F.col("base.url").alias("referrer"), "pos", urls.resolve_with(F.col("base"), F.col("link")).alias("url")).where("url is not null")
    return out.where(urls.in_scope(F.col("url"), scope)) if scope else out


def resume(root: str, visited: DataFrame, pushed: DataFrame) -> DataFrame:
    """Frontier ``(url, depth, referrer)`` from logs: pushed and not yet visited; the root when nothing is left."""
    spark = visited.sparkSession
    left = pushed.select(F.col("url")).distinct().join(visited.select("url"), "url", "left_anti").select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer"))
    return spark.createDataFrame([(root, 0, None)], "url string, depth int, referrer string") if left.isEmpty() else left


def step(frontier: DataFrame, pages: DataFrame, seen: DataFrame, scope: str | None = None, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One breadth-first level: the visit records of the frontier, and the next frontier.

    A frontier page that is not stored is an error, a blank one empty; both count as visited.
    A new address keeps its first referrer (smallest referrer, then position). Levels are
    joins on the address; nothing is gathered.
    """
    now = frontier.orderBy("depth", "url").limit(max_pages) if max_pages is not None else frontier
    stored = pages.select("url", "html").dropDuplicates(["url"])
    visited = now.join(stored, "url", "left")
    status = F.when(F.col("html").isNull(), "error").when(F.length(F.trim("html")) == 0, "empty").otherwise("ok")
    records = visited.select("url", "depth", "referrer", status.alias("status"), F.size(urls.links(F.col("html"))).alias("outlink_count"), F.sha2("html", 256).alias("content_hash"))
    links = outlinks(visited.where("html is not null"), scope=scope).join(visited.select(F.col("url").alias("referrer"), "depth"), "referrer")
    first = links.groupBy("url").agg(F.min(F.struct("referrer", "pos", "depth")).alias("f"))
    known = seen.select("url").unionByName(now.select("url")).distinct()
    fresh = first.join(known, "url", "left_anti").select("url", (F.col("f.depth") + 1).alias("depth"), F.col("f.referrer").alias("referrer"))
    return records, fresh


def crawl(root: str, pages: DataFrame, scope: str | None = None, max_pages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Visit records of a whole breadth-first crawl over stored pages, to any depth unless one is given. Each level is checkpointed, so a lost executor repeats one level at most."""
    spark = pages.sparkSession
    frontier = spark.createDataFrame([(root, 0, None)], "url string, depth int, referrer string")
    seen = frontier.select("url").where("false")
    out: DataFrame | None = None
    left = max_pages
    for depth in itertools.count():
        records, fresh = step(frontier, pages, seen, scope, left)
        records = checkpointed(records)
        fresh = checkpointed(fresh.join(records.select("url"), "url", "left_anti"))
        out = records if out is None else out.unionByName(records)
        seen = seen.unionByName(records.select("url"))
        if left is not None:
            left -= records.count()
            if left <= 0:
                break
        if depth == max_depth or fresh.isEmpty():
            break
        frontier = fresh
    return out


def latest(meta: DataFrame) -> DataFrame:
    """The newest record of every address (late rows lose), repeated rows once; ties fall to the larger record."""
    keep = ["url", "depth", "status", "fetched_at", "elapsed_sec", "outlink_count", "content_hash"]
    return meta.groupBy("url").agg(F.max(F.struct("fetched_at", *(c for c in keep if c not in ("url", "fetched_at")))).alias("r")).select("url", "r.*")


def summary(meta: DataFrame) -> DataFrame:
    """Counters of a crawl: attempts, pages saved, distinct addresses, errors."""
    return meta.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "ok").alias("saved"), F.countDistinct("url").alias("visited"), F.count_if(F.expr("error is not null and error <> ''")).alias("errors"))


def distinct_content(pages: DataFrame, html: str = "html", order: str = "source_file") -> DataFrame:
    """One page per content: its hash, its first name, and how often it is stored."""
    return pages.groupBy(F.sha2(html, 256).alias("content_hash")).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def file_names(pages: DataFrame, ts: str, url: str, html: str) -> DataFrame:
    return pages.select(url, tx.page_file_name(ts, url, html).alias("file_name"))


def allowed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links that robots rules let through: the longest matching path prefix of a host decides, allow wins ties, no rule allows."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?]*)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?]*(.*)$", 1)
    l = links.withColumn("_host", host).withColumn("_path", path)
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_prefix"), F.col("allow").alias("_allow"))
    hit = l.join(r, (F.col("_host") == F.col("_h")) & F.startswith("_path", "_prefix"), "left")
    best = hit.groupBy(*links.columns).agg(F.max(F.struct(F.length("_prefix").alias("n"), "_allow")).alias("b"))
    return best.where(F.coalesce("b._allow", F.lit(True))).select(*links.columns)
