"""URL filter by a path-template tree.

Per host, paths are cut into segments, and the tree is generalised level by level from the root.  At a node a
child segment stays literal if its share of the node's pages is significantly above LITERAL; the others become
one wildcard if they are variable: two random pages under them agree in their segment with an estimated
probability below AGREE (an identifier, a date, a title), however many or few segments there are.

Statistically similar siblings are merged: branches of one parent have the same shape if their child steps
have the same shares to the nearest quarter (leaves have the same, empty shape), and pool their labels unless a
branch's share of bad labels differs significantly from its pool's; such a branch stands alone.

A node's purity is the smoothed share of bad labels, (bad + w * above) / (labelled + w) with
w = STRENGTH + DILUTION * unlabelled: it backs off to the purity of its parent (the root's to 1/2), and pages
that nobody labelled dilute what the labelled ones say.  So a template without labels of its own is judged by
its similar siblings and by the branches above, as far as labels cover them.  A path is rejected if the purity
of its template reaches a threshold.

Explicit rules (host suffix and path prefix, the longest wins) come before the templates; by default the
pages that a rule decides are also the labelled ones.

All of it is grouped aggregation over distinct (host, path) pairs.  The aggregations are keyed by host and
prefix after the paths have been counted, so a hot host is a row per distinct path or child there; the
joins that carry a node's decision back to its paths are left to Spark, which broadcasts or splits them.

Defined results: a null URL, or one without ://, has an empty host and path, and no rule fits it; repeated
rows and ids are judged row by row; an empty table gives no rows and no templates; segments past the
DEPTH-th are one segment with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

DEPTH = 4
#: Share of a node's pages from which a child segment is no instance of a variable.
LITERAL = 0.05
#: Probability that two pages agree in a segment, below which the segment is variable.
AGREE = 0.1
STRENGTH = 4.0
DILUTION = 0.25
THRESHOLD = 0.75
Z = 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    prefix: str  # host suffix, /, path prefix

    @property
    def host(self) -> str:
        return self.prefix.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.partition("/")[2]


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def _first_rule(rules: tuple[Rule, ...], what) -> Column:
    """what(rule) of the longest rule that fits (host, path); the list of rules is a short, fixed one."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.prefix), r.prefix)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, ruled): ruled is the verdict of the rule, null without one."""
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    return base.withColumn("rule", _first_rule(rules, lambda r: r.prefix)).withColumn("ruled", _first_rule(rules, lambda r: r.verdict))


def path_templates(paths: DataFrame) -> DataFrame:
    """(host, path, pages, labelled, bad) with the columns t0 to tDEPTH: the path's templates from the root
    down, null below its last, and template, the last."""
    tree = paths.withColumn("parts", F.split("path", "/")).withColumn("t0", F.lit(""))
    for i in range(1, DEPTH + 1):
        above = f"t{i - 1}"
        rest = F.array_join(F.slice("parts", i + 1, F.greatest(F.size("parts") - i, F.lit(0))), "/") if i == DEPTH else F.get("parts", F.lit(i))
        tree = tree.withColumn("s", F.when(F.size("parts") > i, rest))
        under = tree.where(F.col("s").isNotNull())
        node = stored(under.groupBy("host", above).agg(F.sum("pages").alias("n")), "url-nodes")
        child = under.groupBy("host", above, "s").agg(F.sum("pages").alias("c"))
        share = F.col("c") / F.col("n")
        literal = share - Z * F.sqrt(share * (1 - share) / F.col("n")) > LITERAL
        # stored, so that what is summed up by node next is summed up within tasks first, also that of a hot node
        marked = stored(child.join(node, ["host", above]).withColumn("literal", literal), "url-children")
        rest = marked.where("not literal").groupBy("host", above).agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("q"))
        variable = stored(rest.where((F.col("q") + 2) / (F.col("r") * (F.col("r") - 1) + 2) < AGREE).select("host", above, F.lit(True).alias("variable")), "url-variable")
        # both are small then, and of known size, so that they can be broadcast and the paths aren't dealt by host
        named = stored(marked.where("literal").join(variable, ["host", above], "left_semi").select("host", above, "s", "literal"), "url-literal")
        tree = tree.join(variable, ["host", above], "left").join(named, ["host", above, "s"], "left")
        step = F.when(F.col("variable") & F.col("literal").isNull(), F.lit("*")).otherwise(F.col("s"))
        tree = tree.withColumn(f"t{i}", F.when(F.col("s").isNotNull(), F.concat(above, F.lit("/"), step))).drop("s", "variable", "literal")
    return tree.drop("parts").withColumn("template", F.coalesce(*(f"t{i}" for i in range(DEPTH, -1, -1))))


def node_counts(tree: DataFrame) -> DataFrame:
    """(host, depth, parent, template, pages, labelled, bad) of every node of the tree."""
    nodes = [F.struct(F.lit(i).alias("depth"), (F.col(f"t{i - 1}") if i else F.lit(None).cast("string")).alias("parent"), F.col(f"t{i}").alias("template")) for i in range(DEPTH + 1)]
    flat = tree.select("host", "pages", "labelled", "bad", F.explode(F.array(*nodes)).alias("node")).where("node.template is not null")
    return flat.groupBy("host", "node.depth", "node.parent", "node.template").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))


def template_purity(nodes: DataFrame) -> DataFrame:
    """(host, template, depth, purity) of every node of node_counts()."""
    # shapes: a node's child steps that have an eighth of its pages at least, with their shares in quarters
    above = nodes.select("host", F.col("template").alias("parent"), F.col("depth").alias("at"), F.col("pages").alias("whole"))
    steps = nodes.join(above, ["host", "parent"]).where("depth = at + 1").withColumn("share", F.col("pages") / F.col("whole")).where("share >= 0.125")
    step = F.concat(F.expr("substr(template, length(parent) + 2)"), F.lit(":"), F.round(4 * F.col("share")).cast("int"))
    shapes = steps.groupBy("host", "parent", "at").agg(F.array_join(F.array_sort(F.collect_list(step)), ",").alias("shape"))
    shaped = nodes.join(shapes.select("host", F.col("parent").alias("template"), F.col("at").alias("depth"), "shape"), ["host", "template", "depth"], "left").fillna("", ["shape"])
    shaped = stored(shaped, "url-shapes")

    siblings = ["host", "parent", "depth", "shape"]
    pool = shaped.where("depth > 0").groupBy(*siblings).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    usual = (F.col("b") + 1) / (F.col("l") + 2)
    apart = (F.col("labelled") > 0) & (F.abs(F.col("bad") / F.col("labelled") - usual) > Z * F.sqrt(usual * (1 - usual) / F.col("labelled")))
    placed = stored(shaped.join(pool, siblings, "left").withColumn("apart", F.coalesce(apart, F.lit(True))).drop("l", "b"), "url-branches")
    merged = placed.where("not apart").groupBy(*siblings).agg(*(F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "bad")))
    placed = placed.join(merged, siblings, "left")
    own = lambda c: F.when(F.col("apart"), F.col(c)).otherwise(F.col(f"all_{c}"))
    weight = STRENGTH + DILUTION * (F.col("p") - F.col("l"))
    placed = stored(placed.select("host", "template", "parent", "depth", own("pages").alias("p"), own("labelled").alias("l"), own("bad").alias("b")), "url-nodes")
    known = level = placed.where("depth = 0").select("host", "template", "depth", ((F.col("b") + weight * 0.5) / (F.col("l") + weight)).alias("purity"))
    for i in range(1, DEPTH + 1):
        up = level.select("host", F.col("template").alias("parent"), F.col("purity").alias("above"))
        level = placed.where(F.col("depth") == i).join(up, ["host", "parent"]).select("host", "template", "depth", ((F.col("b") + weight * F.col("above")) / (F.col("l") + weight)).alias("purity"))
        level = stored(level, "url-purity")
        known = known.unionByName(level)
    return known


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row."""
    urls = parsed(pages, rules, id_col, url_col)
    counts = [F.count("*").alias("pages"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled") == "block").alias("bad")]
    paths = stored(urls.groupBy("host", "path").agg(*counts), "url-paths")
    tree = stored(path_templates(paths), "url-tree")
    purity = template_purity(node_counts(tree))
    ends = tree.withColumn("depth", sum(F.col(f"t{i}").isNotNull().cast("int") for i in range(1, DEPTH + 1)))
    known = ends.join(purity, ["host", "template", "depth"]).select("host", "path", "template", (F.col("purity") >= threshold).alias("reject"))
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return urls.join(known, ["host", "path"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
