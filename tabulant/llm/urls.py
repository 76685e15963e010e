"""URL filters by a path-template tree per host.

Rules given by the caller decide first.  For the rest a tree of path templates is learned per host:
1. Segments are generalised by their letters: every run of digits becomes ``{n}``.  Below ``depth``
   levels the rest of a path becomes ``**``.
2. At each node with many rare children, the rare ones are variable and become ``*``.
3. Sibling branches whose share of blocked labels does not differ from the pooled share of their
   parent (a z-test) are merged and share their counts.
4. A template is rejected if its purity, the share of blocked labels smoothed towards the share in
   the whole table, reaches ``reject``.
Labels come from the rules and, where no rule fits, from seed terms of known spam in the host.

Pages are summed to distinct templates before anything else; the tree works on those, so a host
with a third of all pages costs one row per template of its paths.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.text import lower_ascii
from tabulant.sources.scratch import materialize

# Verdict, host, path prefix.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SEED_TERMS = ["casino", "free-bets", "cheap-pills", "ads-track"]
DEPTH = 3
WILD_CHILDREN = 20
WILD_SUPPORT = 3
Z = 1.96
PRIOR_WEIGHT = 1.0
REJECT = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; a rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, at + prefix).otherwise(name)
        verdict = F.when(fits, kind).otherwise(verdict)
    return name, verdict


def generalised(path: Column, depth: int) -> Column:
    """Segments with digits as ``{n}``; what lies deeper than ``depth`` is ``**``."""
    segments = F.transform(
        F.array_remove(F.split(path, "/"), ""), lambda s: F.regexp_replace(s, "[0-9]+", "{n}")
    )
    deep = F.concat(F.slice(segments, 1, depth), F.array(F.lit("**")))
    return F.when(F.size(segments) > depth, deep).otherwise(segments)


def _wildcards(tree: DataFrame, level: int, children: int, support: int) -> DataFrame:
    """Rare children of nodes with many become ``*`` at one level."""
    here = F.get("template", F.lit(level))
    tree = tree.withColumn("node", F.array_join(F.slice("template", 1, level), "/")).withColumn("child", here)
    seen = tree.where("child is not null").groupBy("host", "node", "child").agg(F.sum("n").alias("child_n"))
    wide = seen.groupBy("host", "node").agg(F.count("*").alias("branches"))
    rare = (
        seen.join(wide, ["host", "node"])
        .where((F.col("branches") > children) & (F.col("child_n") < support))
        .select("host", "node", "child", F.lit(True).alias("variable"))
    )
    head, tail = F.slice("template", 1, level), F.slice("template", level + 2, 1 << 20)
    starred = F.when(F.col("variable"), F.concat(head, F.array(F.lit("*")), tail)).otherwise(F.col("template"))
    return (
        tree.join(rare, ["host", "node", "child"], "left").withColumn("template", starred).drop("node", "child", "variable")
    )


def template_tree(
    judged: DataFrame,
    depth: int = DEPTH,
    wild_children: int = WILD_CHILDREN,
    wild_support: int = WILD_SUPPORT,
    z: float = Z,
    prior_weight: float = PRIOR_WEIGHT,
) -> DataFrame:
    """Per ``(host, shape)`` its template and the smoothed purity of the branch it belongs to.

    ``judged`` has ``host``, ``shape`` (an array of generalised segments) and ``label``.
    """
    tree = judged.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count("label").alias("labelled"),
        F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
    )
    # every step below reads the tree several times, so each is written once
    tree, _ = materialize(tree.withColumn("template", F.col("shape")), "templates")
    for level in range(depth):
        tree, _ = materialize(_wildcards(tree, level, wild_children, wild_support), "templates")
    tree = tree.withColumn("parent", F.array_join(F.slice("template", 1, F.greatest(F.size("template") - 1, F.lit(0))), "/"))
    tree = tree.withColumn("template", F.array_join("template", "/"))

    sums = [F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")]
    leaves = tree.groupBy("host", "parent", "template").agg(*sums)
    pools = leaves.groupBy("host", "parent").agg(F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_b"))
    share = F.try_divide("pool_b", "pool_n")
    gap = F.abs(F.try_divide("blocked", "labelled") - share)
    alike = (F.col("labelled") > 0) & (gap <= z * F.sqrt(F.try_divide(share * (1 - share), F.col("labelled"))))
    leaves = leaves.join(pools, ["host", "parent"]).withColumn("branch", F.when(alike, "").otherwise(F.col("template")))
    merged = leaves.groupBy("host", "parent", "branch").agg(
        F.sum("labelled").alias("branch_n"), F.sum("blocked").alias("branch_b")
    )
    seen = tree.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = ((seen[0] or 0) + 1) / ((seen[1] or 0) + 2)
    smoothed = (F.col("branch_b") + prior_weight * prior) / (F.col("branch_n") + prior_weight)
    leaves = (
        leaves.join(merged, ["host", "parent", "branch"])
        .select("host", "parent", "template", smoothed.alias("purity"))
    )
    return tree.join(leaves, ["host", "parent", "template"]).select("host", "shape", "template", "purity")


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    rules=RULES,
    seed_terms=SEED_TERMS,
    depth: int = DEPTH,
    reject: float = REJECT,
    **options,
) -> DataFrame:
    """One row per page: its key, ``host, path, rule, verdict, template, purity``.

    A null url or one without ``://`` has an empty host and path; it is judged like any other, in the
    tree of the empty host.  Repeated pages stay.  Other columns are not read.
    """
    host, path = host_and_path(F.col(url))
    judged = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seeded = F.lit(False)
    for term in seed_terms:
        seeded = seeded | F.contains("host", F.lit(term))
    judged = judged.select(
        "*",
        rule.alias("rule"),
        verdict.alias("by_rule"),
        F.coalesce(verdict, F.when(seeded, "block")).alias("label"),
        generalised(F.col("path"), depth).alias("shape"),
    )
    tree = template_tree(judged, depth, **options)
    by_tree = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return judged.join(tree, ["host", "shape"]).select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_tree).alias("verdict"),
        "template",
        F.round("purity", 6).alias("purity"),
    )
