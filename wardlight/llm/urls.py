"""URL filters: a tree of path templates per host, its like branches merged, judged by smoothed labelled purity.

Templates. Segments of a path that vary by shape (numbers, long hexadecimal) become wildcards, then,
from the host down, the rare children of nodes with many. Merging. Branches of a node that have labelled
pages are put in order of their rate of blocked ones; neighbours that a test of two proportions can't
tell apart are one branch, and share their counts. Purity. Each node's rate is smoothed towards what is
above it: the mean of its parent's purity and of the purity of the same template over all hosts, which is
smoothed towards its own parent template. So hosts without labels are judged by what their
templates mean elsewhere. Paths of any depth are taken whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: (verdict, host and path) of rules; a rule fits its host and all subdomains.
Rule = tuple[str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class TreeLimits:
    #: A node with at least so many different children has its rare ones generalised ...
    fanout: int = 20
    #: ... which are those with less than one in so many of the node's pages.
    rare_share: int = 20
    #: Weight of the levels above in a node's purity, as a number of labelled pages.
    prior_weight: float = 4.0
    #: Branches whose rates differ by up to so many standard errors are merged.
    similar: float = 2.0
    #: Templates of at least this purity of blocked pages are rejected.
    reject: float = 0.6
    #: Tables of verdicts and nodes are broadcast up to so many bytes of their text.
    broadcast_bytes: int = 4 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as written, or null; of equal lengths the first given."""
    found = F.lit(None).cast("string")
    for _, written in sorted(reversed(rules), key=lambda r: len(r[1])):  # what comes later goes before
        rule_host, slash, rest = written.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(written)).otherwise(found)
    return found


def general(segment: Column) -> Column:
    """A segment with what varies by shape as *: numbers, long hexadecimal, and numbers with an extension."""
    return (
        F.when(segment.rlike(r"^[0-9]+$|^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("*"))
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.regexp_replace(segment, r"^[0-9]+", "*"))
        .when(segment.rlike(r"[0-9]{4,}"), F.regexp_replace(segment, r"[0-9]+", "*"))
        .otherwise(segment)
    )


def segments(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def small(df: DataFrame, path: str, limits: TreeLimits) -> DataFrame:
    """df, to be broadcast if its paths are known to be few and short; else joined by shuffles, whose hot keys are split at run time."""
    size = df.agg(F.sum(F.lit(64) + F.octet_length(F.concat_ws("/", path)))).first()[0] or 0
    return F.broadcast(df) if size <= limits.broadcast_bytes else df


def starred(k: int) -> Column:
    return F.transform("t", lambda x, i: F.when((i == k) & F.col("rare"), "*").otherwise(x))


def generalise(found: DataFrame, limits: TreeLimits) -> DataFrame:
    """Adds t to rows of (host, segs, n, ...): segs with the rare children of nodes with many as *.

    Level by level along what is already generalised, as long as a node has enough templates below
    it to have so many children; a lone path, however deep, takes no further level. Counts are by (host,
    node, child) before (host, node), so no host is one group.
    """
    found, k = found.withColumn("t", F.col("segs")), 0
    while True:
        prefix, child = F.slice("t", 1, k).alias("prefix"), F.get("t", F.lit(k)).alias("child")
        children = found.where(F.size("t") > k).groupBy("host", prefix, child).agg(F.sum("n").alias("child_n"), F.count("*").alias("below"))
        nodes = children.groupBy("host", "prefix").agg(F.sum("child_n").alias("node_n"), F.count("*").alias("children"), F.sum("below").alias("below"))
        most = nodes.agg(F.max("children").alias("children"), F.max("below").alias("below")).first()
        if (most["below"] or 0) < limits.fanout:
            return found
        if most["children"] >= limits.fanout:
            many = nodes.where(F.col("children") >= limits.fanout).select("host", "prefix", "node_n")
            rare = children.join(many, ["host", "prefix"]).where(F.col("child_n") * limits.rare_share < F.col("node_n")).select("host", "prefix", "child", F.lit(True).alias("rare"))
            at = found.select("*", prefix, child).join(rare, ["host", "prefix", "child"], "left")
            found = materialize(at.withColumn("t", starred(k)).drop("prefix", "child", "rare"), "url-templates")
        k += 1


def branches(found: DataFrame, limits: TreeLimits) -> tuple[DataFrame, DataFrame]:
    """Labelled nodes of the hosts' trees with the counts of the branch they are merged into (host, prefix, lab,
    blk), and of the same templates over all hosts (prefix, all_lab, all_blk)."""
    paths = found.where("lab > 0").groupBy("host", "t").agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk")).where(F.size("t") > 0)
    depth = F.explode(F.sequence(F.lit(1), F.size("t"))).alias("d")
    nodes = paths.select("host", "t", "lab", "blk", depth).groupBy("host", F.slice("t", F.lit(1), F.col("d")).alias("prefix")).agg(F.sum("lab").alias("lab"), F.sum("blk").alias("blk"))
    nodes = materialize(nodes.withColumn("parent", F.slice("prefix", F.lit(1), F.size("prefix") - 1)), "url-nodes")
    shared = nodes.groupBy("prefix").agg(F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"))
    rate = F.col("blk").cast("double") / F.col("lab")
    # after generalising, a node has few branches, so a window holds few rows
    order = Window.partitionBy("host", "parent").orderBy("rate", "prefix")
    near = nodes.withColumn("rate", rate).withColumn("lab_0", F.lag("lab").over(order)).withColumn("blk_0", F.lag("blk").over(order)).withColumn("rate_0", F.lag("rate").over(order))
    pooled = (F.col("blk") + F.col("blk_0")).cast("double") / (F.col("lab") + F.col("lab_0"))
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("lab") + F.lit(1.0) / F.col("lab_0")))
    apart = F.when(F.coalesce(F.col("rate") - F.col("rate_0") > limits.similar * error, F.lit(False)), 1).otherwise(0)
    near = near.withColumn("branch", F.sum(apart).over(order))
    whole = Window.partitionBy("host", "parent", "branch")
    return near.select("host", "prefix", F.sum("lab").over(whole).alias("lab"), F.sum("blk").over(whole).alias("blk")), shared


def purities(found: DataFrame, limits: TreeLimits) -> DataFrame:
    """(host, t, purity) of all templates of rows (host, t, lab, blk)."""
    w = limits.prior_weight
    total = found.agg(F.sum("blk").alias("b"), F.sum("lab").alias("l")).first()
    overall = ((total["b"] or 0) + 0.5) / ((total["l"] or 0) + 1.0)
    own, shared = branches(found, limits)
    hosts = found.groupBy("host").agg(F.sum("lab").alias("host_lab"), F.sum("blk").alias("host_blk"))
    templates = materialize(found.select("host", "t").distinct(), "url-distinct")
    # depth 0, the host itself, is a step without counts, so that every template has a path
    steps = templates.select("host", "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("d")).withColumn("prefix", F.slice("t", F.lit(1), F.col("d")))
    steps = steps.join(small(own, "prefix", limits), ["host", "prefix"], "left").join(small(shared, "prefix", limits), "prefix", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("lab", "blk", "all_lab", "all_blk")]
    path = steps.groupBy("host", "t").agg(F.sort_array(F.collect_list(F.struct("d", *counts))).alias("path"))
    path = path.withColumn("path", F.filter("path", lambda x: x["d"] > 0)).join(hosts, "host")
    start = F.struct(F.lit(overall).alias("all"), ((F.col("host_blk") + w * overall) / (F.col("host_lab") + w)).alias("own"))

    def step(above: Column, x: Column) -> Column:
        everywhere = (x["all_blk"] + w * above["all"]) / (x["all_lab"] + w)
        return F.struct(everywhere.alias("all"), ((x["blk"] + w * ((everywhere + above["own"]) / 2)) / (x["lab"] + w)).alias("own"))

    return path.select("host", "t", F.aggregate("path", start, step)["own"].alias("purity"))


def judge(df: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limits: TreeLimits = TreeLimits(), label: Column | None = None) -> DataFrame:
    """Allows or blocks each url: by the longest fitting rule, else by its path template.

    Pages that a rule decides are the labelled ones (label, 1 blocked and 0 allowed, replaces that).
    Result, a row per row of df: id_col, host, path, rule, verdict, template, purity. Urls that
    are null or have no :// have an empty host and path and form a template of their own. Repeated
    rows count as often as they occur; an empty table gives an empty result; other columns of df, whatever
    their names, take no part.
    """
    host, path = host_and_path(F.col("u_url"))
    verdict = F.lit(None).cast("string")
    for said, written in rules:
        verdict = F.when(F.col("rule") == written, F.lit(said)).otherwise(verdict)
    rows = df.select(F.col(id_col).alias("u_id"), F.col(url_col).cast("string").alias("u_url"), (F.lit(None).cast("int") if label is None else label.cast("int")).alias("given"))
    rows = rows.select("u_id", host.alias("host"), path.alias("path"), "given").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("said", verdict)
    by_rule = F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0)
    rows = rows.withColumn("label", F.col("given") if label is not None else by_rule).drop("given").withColumn("segs", segments(F.col("path")))
    with scratch() as keep:
        counts = F.count("*").alias("n"), F.count("label").alias("lab"), F.sum(F.coalesce(F.col("label"), F.lit(0))).cast("bigint").alias("blk")
        found = generalise(materialize(rows.groupBy("host", "segs").agg(*counts), "url-counts"), limits)
        # the join of templates with their purity meets each row once; a hot host's templates are few after generalising
        verdicts = materialize(found.select("host", "segs", "t").join(purities(found, limits), ["host", "t"]).select("host", "segs", "t", "purity"), "url-verdicts")
        judged = rows.join(small(verdicts, "segs", limits), ["host", "segs"], "left")
        tree = F.when(F.col("purity") >= limits.reject, F.lit("block")).otherwise("allow")
        template = F.concat(F.lit("/"), F.array_join("t", "/")).alias("template")
        return keep(judged.select(F.col("u_id").alias(id_col), "host", "path", "rule", F.coalesce("said", tree).alias("verdict"), template, "purity"), "url-judged")
