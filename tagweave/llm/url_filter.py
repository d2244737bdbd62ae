"""Operator 2: URL verdicts by explicit rules, and by path templates learned per host.

Rules (host and path prefix, longest wins) decide first.  Every other URL is judged by the
template its path falls under.  Templates are the nodes of a tree per host, built level by
level from the distinct generalised paths: a segment that looks like an id becomes a wildcard;
siblings whose labelled shares do not differ significantly are merged.  Among too many siblings
those with few labels, or not significantly unlike the others together, become one wildcard.
Growth ends where paths end or, below ``DEPTH``, where labels tell nothing apart.  A template is rejected when the bad share of its labelled URLs, smoothed towards
its host's and that towards the overall share, passes a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagweave.session import cut_lineage

#: Levels that grow whatever their labels; deeper ones below nodes with good and bad labels only.
DEPTH = 4
#: Siblings beyond which segments must earn a branch of their own.
MAX_CHILDREN = 24
#: Labelled URLs that a segment needs for a branch among too many siblings, and a deep node to grow.
MIN_SUPPORT = 5
#: Segment of a template that stands for all others: siblings without a branch, or a tail.
REST = "**"
#: |z| of two labelled shares below which neighbouring siblings are merged.
MERGE_Z = 1.96
#: Labelled URLs that the prior of the level above counts for.
PRIOR = 10.0
#: Smoothed bad share above which a template is blocked.
REJECT = 0.5

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""
    verdict: str
    host: str
    path: str

    @staticmethod
    def parse(line: str) -> "Rule":
        """``block example.com/de/`` -> verdict, host and path prefix."""
        verdict, target = line.split(" ", 1)
        host, slash, rest = target.partition("/")
        if verdict not in (ALLOW, BLOCK) or not slash:
            raise ValueError(f"not a rule: {line!r}")
        return Rule(verdict, host, slash + rest)

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<name, verdict>; null without one."""
    if not rules:
        return F.lit(None).cast("struct<name:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    chosen = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        hit = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        chosen = F.when(fits, hit) if chosen is None else chosen.when(fits, hit)
    return chosen


def _segments(path: Column) -> Column:
    """All segments of the path, ids generalised."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$"), "*")
                       .when(s.rlike(r"^\d+\.[A-Za-z]{1,5}$"), F.concat(F.lit("*."), F.substring_index(s, ".", -1)))
                       .when(s.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$") | s.rlike(r"^\d{4}-\d\d(-\d\d)?$"), "*")
                       .otherwise(s)).alias("segments")


def _apart(b: Column, n: Column, b0: Column, n0: Column) -> Column:
    """Whether two labelled shares differ significantly."""
    shared = (b + b0) / (n + n0)
    return F.abs(b / n - b0 / n0) > MERGE_Z * F.sqrt(shared * (1 - shared) * (1 / n + 1 / n0))


def _grow(leaves: DataFrame, level: int) -> DataFrame:
    """Leaves with ``template`` extended by segment ``level``, generalised and merged with siblings."""
    seg = "segment"
    leaves = leaves.withColumn(seg, F.get("segments", F.lit(level)))
    # Distinct segments of a node are counted without bringing a node's children together.
    nodes = leaves.filter(F.col(seg).isNotNull()).groupBy("host", "template", seg) \
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    whole = nodes.groupBy("host", "template").agg(
        (F.count("*") > MAX_CHILDREN).alias("crowded"), F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_b"))
    if level >= DEPTH:
        mixed = (F.col("all_b") > 0) & (F.col("all_b") < F.col("all_n")) & (F.col("all_n") >= MIN_SUPPORT)
        whole = whole.withColumn("grows", mixed)
    else:
        whole = whole.withColumn("grows", F.lit(True))
    others_n, others_b = F.col("all_n") - F.col("labelled"), F.col("all_b") - F.col("bad")
    unlike_rest = F.when(others_n > 0, _apart(F.col("bad"), F.col("labelled"), others_b, others_n)).otherwise(True)
    earned = F.when(F.col("labelled") >= MIN_SUPPORT, unlike_rest).otherwise(False)
    named = nodes.join(whole, ["host", "template"]) \
        .withColumn("child", F.when(F.col("crowded") & ~earned | ~F.col("grows"), REST).otherwise(F.col(seg)))
    # Branches of a crowded node stand alone, so at most MAX_CHILDREN siblings meet in a window.
    single = named.filter("crowded or not grows").select("host", "template", seg, F.col("child").alias("name"), "grows")
    named = named.filter("not crowded and grows")
    children = named.groupBy("host", "template", "child").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b"))
    siblings = Window.partitionBy("host", "template").orderBy(F.col("b") / F.greatest("n", F.lit(1)), "child")
    n0, b0 = F.lag("n").over(siblings), F.lag("b").over(siblings)
    apart = _apart(F.col("b"), F.col("n"), F.col("b0"), F.col("n0"))
    # Without labels on both sides there is nothing to tell siblings apart by, nor to merge them for.
    unlike = F.when((F.col("n") > 0) & (F.col("n0") > 0), apart).otherwise(True)
    running = siblings.rowsBetween(Window.unboundedPreceding, 0)
    grouped = children.withColumn("n0", n0).withColumn("b0", b0) \
        .withColumn("branch", F.sum(F.when(unlike, 1).otherwise(0)).over(running))
    names = grouped.groupBy("host", "template", "branch").agg(F.array_sort(F.collect_set("child")).alias("members"))
    merged = names.select("host", "template", F.explode("members").alias("child"), F.array_join("members", "|").alias("name"))
    renamed = named.select("host", "template", seg, "child").join(merged, ["host", "template", "child"]) \
        .select("host", "template", seg, "name", F.lit(True).alias("grows")).unionByName(single)
    grown = leaves.join(renamed, ["host", "template", seg], "left")
    return grown.withColumn("template", F.when(F.col("name").isNull(), F.col("template"))
                            .otherwise(F.concat_ws("/", "template", "name"))) \
        .withColumn("open", F.coalesce(F.col("grows") & (F.size("segments") > level + 1), F.lit(False))) \
        .drop("name", "grows", seg)


def learn_templates(labelled: DataFrame) -> DataFrame:
    """Template and smoothed bad share of every distinct generalised path.

    ``labelled`` has ``host``, ``segments`` and ``bad`` (boolean; null: unlabelled).  Result:
    ``host``, ``segments``, ``template``, ``bad_share``, one row per distinct host and path form.
    """
    leaves = labelled.groupBy("host", "segments").agg(
        F.count("bad").alias("labelled"), F.sum(F.coalesce(F.col("bad").cast("long"), F.lit(0))).alias("bad"))
    leaves = cut_lineage(leaves.withColumn("template", F.lit("")).withColumn("open", F.size("segments") > 0))
    level = 0
    while not leaves.filter("open").isEmpty():
        grown = _grow(leaves.filter("open"), level).unionByName(leaves.filter("not open"))
        leaves = cut_lineage(grown)
        level += 1
    whole = leaves.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("n")).first()
    overall = (whole["b"] + 1.0) / (whole["n"] + 2.0)
    hosts = leaves.groupBy("host").agg(((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("host_share"))
    shares = leaves.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).join(hosts, "host") \
        .select("host", "template", ((F.col("b") + PRIOR * F.col("host_share")) / (F.col("n") + PRIOR)).alias("bad_share"))
    return leaves.join(shares, ["host", "template"]).select("host", "segments", "template", "bad_share")


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, bad_share`` of every page.

    ``labels`` has ``page_id`` (unique) and ``bad``; without it, or for hosts without labels,
    templates stand at the prior, so what no rule blocks is allowed.  Null URLs and URLs without
    ``://`` have an empty host and path.  Repeated pages come back repeatedly; empty in, empty out.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = urls.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"),
                         _segments(F.col("path")))
    bad = F.lit(None).cast("boolean").alias("bad")
    known = parsed.join(labels.select("page_id", "bad"), "page_id", "left") if labels is not None \
        else parsed.select("*", bad)
    learned = learn_templates(known.select("host", "segments", "bad")).withColumnsRenamed(
        {c: f"__{c}" for c in ("host", "segments")})
    same = (F.col("host") == F.col("__host")) & (F.col("segments") == F.col("__segments"))
    share = F.coalesce("bad_share", F.lit(0.0))
    return parsed.join(learned, same, "left").select(
        "page_id", "host", "path", F.col("fit.name").alias("rule"),
        F.coalesce("fit.verdict", F.when(share > REJECT, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.concat("host", "template").alias("template"), "bad_share")
