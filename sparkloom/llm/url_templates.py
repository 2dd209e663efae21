"""URL filtering by a tree of path templates per host. DataFrame functions only.

Paths are cut into segments and each host's distinct paths are counted first, so a host that holds a
large share of the pages is one row per distinct path. From the deepest level up, the children of each node
stay apart or are merged, their subtrees being templates already: children that are variable (many, each
rare) become the wildcard ``*``; of the others, which are few, those are merged whose labels do not differ
significantly by a likelihood-ratio test, neither in all nor template by template of their subtrees.
Children without labels are merged with those whose subtrees have the same templates. A template is
rejected when its smoothed share of bad labels reaches the threshold; the share is smoothed towards its
host's, that towards the share of all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import col
from sparkloom.shipping import checkpoint

MOST_CHILDREN = 8
#: A child of less than this share of a node with more than MOST_CHILDREN children is variable; so at most
#: 1 / RARE children are compared at a node.
RARE = 0.02
#: The normal quantile of the tests.
Z = 1.645
#: Segments beyond this are one last segment.
MOST_LEVELS = 64
PRIOR_LABELS = 4.0
THRESHOLD = 0.5
MAX_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path in one string) and its verdict, null where none fits.

    ``rules`` are (verdict, host, path); one fits its host and subdomains. They are a parameter, at most
    MAX_RULES.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """Segments, with runs of digits and long hexadecimal words generalised. The marks of templates are
    escaped."""
    plain = F.replace(F.replace(F.replace(path, F.lit("*"), F.lit("%2A")), F.lit("("), F.lit("%28")), F.lit("|"), F.lit("%7C"))
    marked = F.regexp_replace(F.regexp_replace(plain, r"(?<![^/])[0-9A-Fa-f-]{16,}(?![^/])", "{hex}"), r"[0-9]+", "{n}")
    return F.filter(F.split(marked, "/"), lambda s: s != "")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "good", "bad")]


def _part(observed: Column, of: Column, share: Column) -> Column:
    return F.when(observed > 0, observed * F.ln(observed / (of * share))).otherwise(0.0)


def likelihood_ratio(good_a: Column, bad_a: Column, good_b: Column, bad_b: Column) -> Column:
    """The statistic of equal shares of bad labels on both sides, chi-square of one degree; 0 without labels."""
    n_a, n_b = good_a + bad_a, good_b + bad_b
    bad = F.coalesce(F.try_divide(bad_a + bad_b, n_a + n_b), F.lit(0.0))
    sides = _part(bad_a, n_a, bad) + _part(good_a, n_a, 1 - bad) + _part(bad_b, n_b, bad) + _part(good_b, n_b, 1 - bad)
    return F.when((n_a > 0) & (n_b > 0), 2 * sides).otherwise(0.0)


def critical(degrees: Column) -> Column:
    """The upper 5 % point of chi-square, by the cube-root approximation; about 3.8 at one degree."""
    c = 2.0 / (9 * degrees)
    return degrees * F.pow(1 - c + Z * F.sqrt(c), F.lit(3))


def template_tree(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, parts, n, good, bad; one row a distinct path) with ``template``, "" for a path
    without segments. There are as many rounds as levels that two paths of a host reach, and one more: a
    path that goes on alone has nothing to be merged with, so its rest is one segment."""
    depths = paths.groupBy("host", F.size("parts").alias("depth")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("host").orderBy(F.desc("depth")))
    shared = checkpoint(depths.withColumn("upto", upto).groupBy("host").agg(F.max(F.when(F.col("upto") > 1, F.col("depth"))).alias("shared")))
    levels = F.least(F.coalesce("shared", F.lit(0)), F.lit(MOST_LEVELS))
    rest = F.slice("parts", levels + 1, F.greatest(F.size("parts"), F.lit(1)))
    parts = F.when(F.size("parts") <= levels, F.col("parts")).otherwise(F.concat(F.slice("parts", F.lit(1), levels), F.array(F.array_join(rest, "/"))))
    rows = checkpoint(paths.join(shared, "host").select("host", "path", parts.alias("parts"), "n", "good", "bad", F.lit("").alias("template")))
    deepest = rows.agg(F.coalesce(F.max(F.size("parts")), F.lit(0))).first()[0]
    for depth in range(deepest, 0, -1):
        rows = checkpoint(_fold(rows, depth))
    return rows


def _fold(rows: DataFrame, depth: int) -> DataFrame:
    """Give the segments at ``depth`` their labels: ``template``, of what is below, gets the label in front."""
    node, here = ["host", "prefix"], F.size("parts") >= depth
    at = rows.withColumn("prefix", F.when(here, F.array_join(F.slice("parts", 1, depth - 1), "/"))).withColumn("segment", F.when(here, F.get("parts", F.lit(depth - 1))))
    cells = checkpoint(at.where("segment is not null").groupBy(*node, "segment", "template").agg(*_sums()))
    children = cells.groupBy(*node, "segment").agg(F.sum("n").alias("n"))
    nodes = children.groupBy(*node).agg(F.count("*").alias("children"), F.sum("n").alias("all_n"))
    variable = (F.col("children") > MOST_CHILDREN) & (F.col("n") < RARE * F.col("all_n"))
    children = checkpoint(children.join(nodes, node).select(*node, "segment", F.when(variable, F.lit("*")).otherwise(F.col("segment")).alias("branch")))
    cells = checkpoint(cells.join(children, [*node, "segment"]).groupBy(*node, "branch", "template").agg(*_sums()))
    labels = branch_labels(cells)
    names = children.join(labels, [*node, "branch"]).select(*node, "segment", "label")
    named = at.join(names, [*node, "segment"], "left")
    return named.select("host", "path", "parts", "n", "good", "bad", F.when(F.col("label").isNull(), F.col("template")).otherwise(F.concat(F.lit("/"), "label", "template")).alias("template"))


def branch_labels(cells: DataFrame) -> DataFrame:
    """(host, prefix, branch, label) from ``cells`` (host, prefix, branch, template, n, good, bad), where at most about
    1 / RARE branches hang at a prefix."""
    node = ["host", "prefix"]
    branches = cells.groupBy(*node, "branch").agg(*_sums(), F.bit_xor(F.xxhash64("template")).alias("structure"), F.count("*").alias("templates"))
    marked = F.col("good") + F.col("bad") > 0
    share = (F.col("bad") + 1) / (F.col("good") + F.col("bad") + 2)
    in_order = branches.where(marked).withColumn("share", share).withColumn("before", F.lag("branch").over(W.partitionBy(*node).orderBy("share", "branch")))
    # subtrees of neighbours in this order, template by template
    mine = cells.select(*node, "branch", "template", "good", "bad")
    theirs = cells.select(*node, F.col("branch").alias("before"), "template", F.col("good").alias("good_b"), F.col("bad").alias("bad_b"))
    both = in_order.select(*node, "branch", "before").join(mine, [*node, "branch"]).join(theirs, [*node, "before", "template"])
    both = both.where("good + bad > 0 and good_b + bad_b > 0")
    ratio = F.sum(likelihood_ratio(*(F.col(c) for c in ("good", "bad", "good_b", "bad_b"))))
    apart = both.groupBy(*node, "branch").agg((ratio > critical(F.count("*").cast("double"))).alias("apart"))
    listed = in_order.join(apart, [*node, "branch"], "left").groupBy(*node).agg(F.sort_array(F.collect_list(F.struct("share", "branch", "good", "bad", F.coalesce("apart", F.lit(False)).alias("apart")))).alias("all"))
    # along the order, a branch joins the group before it unless it differs from the group or its neighbour
    none = F.array().cast("array<struct<branch:string,group:int>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("group"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))

    def take(state: Column, x: Column) -> Column:
        new = x["apart"] | (likelihood_ratio(state["good"], state["bad"], x["good"], x["bad"]) > critical(F.lit(1.0)))
        group = state["group"] + F.when(new, 1).otherwise(0)
        done = F.concat(state["done"], F.array(F.struct(x["branch"].alias("branch"), group.alias("group"))))
        good, bad = (x[c] + F.when(new, 0.0).otherwise(state[c]) for c in ("good", "bad"))
        return F.struct(done.alias("done"), group.alias("group"), good.alias("good"), bad.alias("bad"))

    grouped = listed.select(*node, F.explode(F.aggregate("all", start, take)["done"]).alias("x")).select(*node, "x.branch", F.col("x.group").cast("string").alias("group"))
    told = checkpoint(branches.join(grouped, [*node, "branch"], "left"))
    # those without labels go with their like: the labelled group of the same structure if it is one, else each other
    of_kind = told.groupBy(*node, "structure", "templates").agg(F.count_distinct("group").alias("groups"), F.min("group").alias("one"))
    alone = F.concat(F.lit("="), "branch")
    kind = F.when(F.col("groups") == 1, F.col("one")).when(F.col("groups") == 0, F.concat(F.lit("~"), F.col("structure").cast("string"))).otherwise(alone)
    told = told.join(of_kind, [*node, "structure", "templates"]).select(*node, "branch", "n", F.coalesce("group", kind).alias("group"))
    groups = told.groupBy(*node, "group").agg(F.sort_array(F.collect_list("branch")).alias("members"), F.sum("n").alias("n"))
    several = (F.size("members") > 1).cast("int")
    wild = F.array_contains("members", "*").cast("int")
    first = F.row_number().over(W.partitionBy(*node).orderBy(wild.desc(), several.desc(), F.desc("n"), "group")) == 1
    label = F.when(F.size("members") == 1, F.element_at("members", 1)).when(first, F.lit("*")).otherwise(F.concat(F.lit("("), F.array_join("members", "|"), F.lit(")")))
    return groups.withColumn("label", label).select(*node, F.explode("members").alias("branch"), "label")


def url_verdicts(
    df: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD, prior: float = PRIOR_LABELS
) -> DataFrame:
    """One row per row of ``df``: ``page_id, host, path, rule, verdict, template, bad_share``.

    ``labels`` (id, bad) marks some ids: 1 bad, 0 good; null labels do not count and labels of a
    repeated id are averaged. The verdict is the rule's where one fits, else block where the template's
    smoothed share of bad labels is at least ``threshold``. A null url has an empty host and path, a
    template of its own. Repeated rows each count and each get the result; a null id has no label.
    Without any label, the share of all is 0.
    """
    host, path = host_and_path(col(df, url_col).cast("string"))
    pages = df.select(col(df, id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("parts", shape(F.col("path")))
    pages = pages.withColumn("shape", F.array_join("parts", "/"))
    marks = labels.where("id is not null and bad is not null").groupBy("id").agg(F.avg("bad").alias("bad"))
    counted = (
        pages.join(marks, F.col("page_id") == F.col("id"), "left")
        .groupBy("host", "shape")
        .agg(
            F.any_value("parts").alias("parts"),
            F.count("*").alias("n"),
            F.coalesce(F.sum(1 - F.col("bad")), F.lit(0.0)).alias("good"),
            F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"),
        )
        .withColumnRenamed("shape", "path")
    )
    tree = template_tree(checkpoint(counted))
    hosts = tree.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    bad, all_labels = hosts.agg(F.coalesce(F.sum("host_bad"), F.lit(0.0)), F.coalesce(F.sum(F.col("host_good") + F.col("host_bad")), F.lit(0.0))).first()
    base = bad / all_labels if all_labels else 0.0
    host_share = (F.col("host_bad") + prior * base) / (F.col("host_good") + F.col("host_bad") + prior)
    templates = tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).join(hosts, "host")
    shares = templates.select("host", "template", F.round((F.col("bad") + prior * host_share) / (F.col("good") + F.col("bad") + prior), 9).alias("bad_share"))
    of_path = checkpoint(tree.join(shares, ["host", "template"]).select("host", F.col("path").alias("shape"), "template", "bad_share"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return pages.join(of_path, ["host", "shape"]).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_share") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("template") == "", F.lit("/")).otherwise(F.col("template")).alias("template"),
        "bad_share",
    )


def labels_from(table: DataFrame) -> DataFrame:
    """(id, bad) from the labels table: bad is quality 0 or toxic 1; null if both are null."""
    signs = [F.when(F.col("quality") == 0, 1.0).when(F.col("quality").isNotNull(), 0.0), F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic").isNotNull(), 0.0)]
    return table.select(F.col("doc_id").alias("id"), reduce(F.greatest, signs).alias("bad"))
