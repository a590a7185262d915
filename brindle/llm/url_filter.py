"""URL filter by path templates, in DataFrame operations only.

Paths of a host form a tree of segments. Segments that look like ids become a wildcard at once; then, from the host
down, the rare children of a node with many children do. Sibling branches that have labels, and whose shares of
rejected labels don't differ significantly, are merged. A template's purity is its share of rejected labels, smoothed
towards that of its parent, which is smoothed towards its own parent's, up to the host and a constant prior; so labels
reach all templates of their host, the weaker the more labels lie between. Explicit rules come first, and supply
labels; labelled URLs may be given besides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.scratch import attached, stored

#: A node with more children than FANOUT keeps those with STRONG of its pages and more, so 1 / STRONG at most.
FANOUT, STRONG = 30, 0.05
#: Labels that a parent's share counts for, the host's own prior share, the share from which a template is rejected,
#: and how many standard errors siblings may be apart.
PRIOR_LABELS, PRIOR, REJECT, APART = 2.0, 0.1, 0.5, 1.64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ID = r"^([0-9]+(\.[A-Za-z]{1,5})?|[0-9A-Fa-f]{8,}|[0-9A-Fa-f]{8}-[0-9A-Fa-f-]{9,}|[0-9]{4}-[0-9]{2}(-[0-9]{2})?|.*[0-9]{4,}.*)$"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are (verdict, host and path)."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _put(array: str, depth: int, value: Column) -> Column:
    return F.transform(array, lambda s, i: F.when(i == depth - 1, value).otherwise(s))


def _prefix(segments: str, depth: int | Column) -> Column:
    return F.array_join(F.slice(segments, 1, depth), "/")


def _next_branch(tree: DataFrame, depth: int) -> int | None:
    """The first depth from ``depth`` on at which some node has several children, if there is one."""
    ends = tree.filter(F.size("segments") >= depth).groupBy("host", _prefix("segments", depth - 1).alias("parent")).agg(F.min("segments").alias("a"), F.max("segments").alias("b"))
    # all arrays between the least and the greatest share what these two share
    agree = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    branches = ends.filter("a <> b").select(F.array_position(agree, False).alias("at"))
    return branches.agg(F.min("at")).first()[0]


def _wildcards(tree: DataFrame) -> DataFrame:
    """The tree (host, lexical, segments, n, ...) with the rare children of wide nodes as wildcards."""
    depth = _next_branch(tree, 1)
    while depth is not None:
        tree = tree.withColumns({"parent": _prefix("segments", depth - 1), "segment": F.coalesce(F.get("segments", F.lit(depth - 1)), F.lit(""))})
        child = stored(tree.filter("segment not in ('', '*')").groupBy("host", "parent", "segment").agg(F.sum("n").alias("pages")), "children")
        wide = stored(child.groupBy("host", "parent").agg(F.count("*").alias("fanout"), F.sum("pages").alias("all_pages")).filter(F.col("fanout") > FANOUT), "wide")
        if not wide.isEmpty():
            strong = child.join(wide, ["host", "parent"]).filter(F.col("pages") >= STRONG * F.col("all_pages")).select("host", "parent", "segment", F.lit(True).alias("strong"))
            tree = tree.join(wide.select("host", "parent", F.lit(True).alias("wide")), ["host", "parent"], "left").join(stored(strong, "strong"), ["host", "parent", "segment"], "left")
            loose = F.col("wide") & F.col("strong").isNull() & (F.col("segment") != "")
            segments = F.when(F.coalesce(loose, F.lit(False)), _put("segments", depth, F.lit("*"))).otherwise(F.col("segments"))
            tree = stored(tree.withColumn("segments", segments).drop("wide", "strong"), f"tree-{depth}")
        tree = tree.drop("parent", "segment")
        depth = _next_branch(tree, depth + 1)
    return tree


def _sibling_depths(templates: DataFrame) -> list[int]:
    """Depths at which templates of a host differ in one segment alone, deepest first; as many as a path has segments."""
    sides = templates.select("host", "merged", F.explode(F.sequence(F.lit(1), F.size("merged"))).alias("depth")).distinct()
    others = F.transform("merged", lambda s, i: F.when(i == F.col("depth") - 1, "").otherwise(s))
    pairs = sides.groupBy("host", "depth", F.xxhash64(F.array_join(others, "/")).alias("others")).agg(F.count("*").alias("n"))
    return sorted((r.depth for r in pairs.filter("n > 1").select("depth").distinct().collect()), reverse=True)


def _merged(templates: DataFrame) -> DataFrame:
    """(host, segments, merged) of the templates (host, segments, labels, rejected) with labels: similar siblings share ``merged``."""
    templates = stored(templates.filter("labels > 0 and size(segments) > 0").withColumn("merged", F.col("segments")), "labelled")
    last: int | None = None
    while depths := [d for d in _sibling_depths(templates) if last is None or d < last]:
        last = depths[0]
        nodes = templates.groupBy("host", "merged").agg(F.sum("labels").alias("labels"), F.sum("rejected").alias("rejected"))
        nodes = nodes.filter(F.size("merged") >= last).withColumn("segment", F.element_at("merged", last)).filter("segment <> '*'")
        nodes = nodes.withColumns({"others": _put("merged", last, F.lit("")), "share": F.col("rejected") / F.col("labels")})
        siblings = Window.partitionBy("host", "others").orderBy("share", "segment")
        pooled = (F.col("rejected") + F.lag("rejected").over(siblings)) / (F.col("labels") + F.lag("labels").over(siblings))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / F.lag("labels").over(siblings)))
        near = F.col("share") - F.lag("share").over(siblings) <= APART * error
        nodes = nodes.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("set", F.sum("new").over(siblings))
        together = F.array_sort(F.collect_set("segment").over(Window.partitionBy("host", "others", "set")))
        label = F.when(F.size(together) > 1, F.concat(F.lit("{"), F.array_join(together, "|"), F.lit("}"))).otherwise(F.col("segment"))
        nodes = nodes.withColumn("label", label)
        nodes = nodes.select("host", F.col("merged").alias("was"), _put("merged", last, F.col("label")).alias("after"))
        templates = templates.withColumnRenamed("merged", "was").join(nodes, ["host", "was"], "left")
        templates = stored(templates.withColumn("merged", F.coalesce("after", "was")).drop("was", "after"), f"merged-{last}")
    return templates.select("host", "segments", "merged")


def _judged(templates: DataFrame) -> DataFrame:
    """(host, segments, merged, purity, basis) of all templates (host, segments, labels, rejected)."""
    templates = templates.join(_merged(templates), ["host", "segments"], "left").withColumn("merged", F.coalesce("merged", "segments"))
    templates = stored(templates, "templates-merged")
    own = templates.groupBy("host", "merged").agg(F.sum("labels").alias("own_labels"), F.sum("rejected").alias("own_rejected"))
    above = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("segments") - 1))).alias("depth")
    prefixes = stored(templates.select("host", "segments", "labels", "rejected", above).withColumn("prefix", _prefix("segments", F.col("depth"))), "prefixes")
    node = prefixes.filter("labels > 0").groupBy("host", "depth", "prefix").agg(F.sum("labels").alias("node_labels"), F.sum("rejected").alias("node_rejected"))
    path = prefixes.join(node, ["host", "depth", "prefix"]).groupBy("host", "segments").agg(F.array_sort(F.collect_list(F.struct("depth", "node_labels", "node_rejected"))).alias("path"))
    judged = templates.select("host", "segments", "merged").join(own, ["host", "merged"]).join(path, ["host", "segments"], "left")
    smooth = lambda rejected, labels, parent: (rejected + PRIOR_LABELS * parent) / (labels + PRIOR_LABELS)
    parent = F.aggregate(F.coalesce("path", F.expr("cast(array() as array<struct<depth: int, node_labels: bigint, node_rejected: bigint>>)")), F.lit(PRIOR), lambda p, x: smooth(x["node_rejected"], x["node_labels"], p))
    # the host's own page has no node above it
    purity = F.when(F.size("segments") == 0, smooth(F.col("own_rejected"), F.col("own_labels"), F.lit(PRIOR))).otherwise(smooth(F.col("own_rejected"), F.col("own_labels"), parent))
    basis = F.when(F.col("own_labels") > 0, "template").when(F.col("path").isNotNull(), "parent").otherwise("prior")
    return judged.select("host", "segments", "merged", purity.alias("purity"), basis.alias("basis"))


def _lexical(path: Column) -> Column:
    parts = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike(_ID), F.lit("*")).otherwise(s))
    return F.array_join(parts, "/")


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]], page_id: str = "page_id", url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity, basis for each row of ``df``.

    Of the rules that fit, the longest decides; otherwise the template's purity does. ``basis`` says on what a verdict
    rests: a "rule", labels of the page's "template" or of a "parent", or the "prior" alone, which allows.
    ``labelled`` (url, rejected) are known URLs whose labels count like those of the rules; nulls are left out.

    A null url, or one without ``://``, has an empty host and path. Repeated rows are judged alike and count as
    pages. Paths of any length and depth are read whole; a segment ``*`` is a wildcard. Other columns are not looked
    at, so their names can't clash. An empty table gives an empty table.
    """
    rows = df.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = stored(rows.withColumn("lexical", _lexical(F.col("path"))), "urls")
    known = rows.select("host", "lexical", F.lit(1).alias("page"), (F.col("found.verdict") == "block").alias("rejected"))
    if labelled is not None:
        other = labelled.filter("url is not null and rejected is not null")
        known = known.unionByName(other.select(host_of(F.col("url")).alias("host"), _lexical(path_of(F.col("url"))).alias("lexical"), F.lit(0).alias("page"), "rejected"))
    counts = {"n": F.sum("page"), "labels": F.count("rejected"), "rejected": F.count_if("rejected")}
    tree = known.groupBy("host", "lexical").agg(*(c.alias(k) for k, c in counts.items()))
    tree = _wildcards(stored(tree.withColumn("segments", F.filter(F.split("lexical", "/"), lambda s: s != "")), "tree"))
    templates = stored(tree.groupBy("host", "segments").agg(F.sum("labels").alias("labels"), F.sum("rejected").alias("rejected")), "templates")
    lookup = tree.filter("n > 0").select("host", "lexical", "segments", "n").join(_judged(templates), ["host", "segments"])
    lookup = stored(lookup.select("host", "lexical", "n", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity", "basis"), "lookup")
    verdict = F.coalesce("found.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    basis = F.when(F.col("found").isNotNull(), "rule").otherwise(F.col("basis"))
    out = attached(rows, lookup, ["host", "lexical"], "n")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity", basis.alias("basis"))
