"""URL filters: fixed rules first, then a tree of path templates for each host.

Segments of a path that are numbers, hashes or identifiers become typed wildcards, and the literal children of a node become
``*`` where they are many and mostly different. From the deepest level up, branches whose share of bad labels doesn't differ
from their siblings' by a two-sided test of proportions are merged into their parent. A template is judged by its nearest branch
that wasn't merged: it is blocked if that branch's share of bad labels, smoothed towards its host's, which is smoothed towards
that of all pages, is at least ``BLOCK_AT``. A host without any label isn't blocked.

Everything is DataFrame work. Pages are reduced to distinct hosts and templates before the tree is made, and the joins back
have one row for each template on the other side, so a host with a third of all pages can be split among tasks.

A null url, or one without ``://``, has an empty host and path; it is judged as the template of the empty host. Without
labels nothing is blocked but by rules. Repeated rows are judged alike; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MANY, SHARE = 20, 0.5
#: Pseudo-counts of smoothing, the share of bad labels that blocks, and the two-sided test's bound.
STRENGTH, BLOCK_AT, Z = 8.0, 0.6, 1.96


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    none = F.lit("")
    return F.coalesce(host, none), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), none)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(str(r))):
        hit = fits(r, host, path)
        name = F.when(hit, str(r)) if name is None else name.when(hit, str(r))
        verdict = F.when(hit, r.verdict) if verdict is None else verdict.when(hit, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def typed(path: Column) -> Column:
    """Segments with numbers, hashes and identifiers generalised."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")

    def one(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "<n>").when(s.rlike(r"^[0-9]+\.[a-z0-9]+$"), F.concat(F.lit("<n>."), F.regexp_extract(s, r"\.([a-z0-9]+)$", 1)))
            .when(s.rlike(r"^[0-9a-fA-F]{8,}$|^[0-9a-fA-F-]{36}$"), "<h>").when(s.rlike(r"[0-9]") & (F.length(s) >= 6), "<x>").otherwise(s)
        )

    return F.transform(segments, one)


def tree(leaves: DataFrame) -> DataFrame:
    """(host, typed, names): the nodes from the host down to each leaf. Literal children of a node become ``*`` where they are
    many and mostly different; what follows a node that holds a single leaf is one node. Levels end when no leaf is left."""
    rows = leaves.groupBy("host", "typed").agg(F.sum("n").alias("n")).withColumn("names", F.array().cast("array<string>"))
    ended, level = [], 0
    while True:
        here = rows.withColumn("segment", F.get("typed", F.lit(level)))
        literal = F.col("segment").isNotNull() & ~F.startswith("segment", F.lit("<"))
        each = here.groupBy("host", "names", "segment").agg(F.sum("n").alias("n"), F.count("*").alias("leaves"))
        nodes = each.groupBy("host", "names").agg(F.sum("leaves").alias("leaves"), F.count_if(literal).alias("kinds"), F.sum(F.when(literal, F.col("n"))).alias("pages"))
        flags = nodes.select("host", "names", (F.col("leaves") == 1).alias("alone"), ((F.col("kinds") >= MANY) & (F.col("kinds") >= SHARE * F.col("pages"))).alias("wild")).where("alone or wild")
        name = F.when(F.col("wild") & literal, "*").otherwise(F.col("segment"))
        rest = F.array_join(F.slice("typed", F.lit(level + 1), F.size("typed")), "/")
        over = F.col("segment").isNull()
        names = F.when(over, F.col("names")).otherwise(F.concat("names", F.array(F.when(F.col("alone"), rest).otherwise(name))))
        rows = materialize(here.join(flags, ["host", "names"], "left").select("host", "typed", "n", names.alias("names"), (over | F.coalesce("alone", F.lit(False))).alias("over")), "url-level")
        ended.append(rows.where("over").select("host", "typed", "names"))
        rows = rows.where("not over").drop("over")
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, ended)
        level += 1


def prefixes(df: DataFrame) -> DataFrame:
    """A row for each node from the host down to ``names``, as ``node``, with its ``level``."""
    return df.withColumn("level", F.explode(F.sequence(F.lit(0), F.size("names")))).withColumn("node", F.slice("names", F.lit(1), F.col("level")))


def kept_branches(templates: DataFrame) -> DataFrame:
    """(host, node, level, n, bad) of nodes that are judged apart, of templates with (host, names, labelled, bad).

    From the deepest level up, a node is tested against its siblings, and what ends at their parent. If it doesn't differ its
    labels go to the parent, else it is kept. Its labels are those that no kept node below it holds, or all where none are left.
    """
    whole = F.size("names") == F.col("level")
    sums = [F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum(F.when(whole, F.col("labelled")).otherwise(0)).alias("own_n"), F.sum(F.when(whole, F.col("bad")).otherwise(0)).alias("own_bad")]
    nodes = materialize(prefixes(templates.where("labelled > 0")).groupBy("host", "node", "level").agg(*sums), "url-nodes")
    depth, kept, given = nodes.agg(F.max("level")).first()[0] or 0, [], None
    one = lambda n: F.greatest(n, F.lit(1))
    for level in range(depth, -1, -1):
        here = nodes.where(F.col("level") == level)
        here = here.withColumns({"more_n": F.lit(0), "more_bad": F.lit(0)}) if given is None else here.join(given, ["host", "node"], "left")
        here = here.withColumns({f"pool_{k}": F.col(f"own_{k}") + F.coalesce(f"more_{k}", F.lit(0)) for k in ("n", "bad")})
        here = here.withColumns({k: F.when(F.col("pool_n") > 0, F.col(f"pool_{k}")).otherwise(F.col(f"all_{k}")) for k in ("n", "bad")})
        if level == 0:
            kept.append(here.select("host", "node", "level", "n", "bad", F.col("all_n").alias("host_n"), F.col("all_bad").alias("host_bad")))
            break
        here = here.withColumn("parent", F.slice("node", F.lit(1), F.lit(level - 1)))
        ends = nodes.where(F.col("level") == level - 1).select("host", F.col("node").alias("parent"), F.col("own_n").alias("n"), F.col("own_bad").alias("bad"))
        total = here.select("host", "parent", "n", "bad").unionAll(ends).groupBy("host", "parent").agg(F.sum("n").alias("sum_n"), F.sum("bad").alias("sum_bad"))
        rest, rest_bad, p = F.col("sum_n") - F.col("n"), F.col("sum_bad") - F.col("bad"), F.col("sum_bad") / one(F.col("sum_n"))
        spread = F.sqrt(p * (1 - p) * (1 / one(F.col("n")) + 1 / one(rest)))
        z = F.abs(F.col("bad") / one(F.col("n")) - rest_bad / one(rest)) / F.greatest(spread, F.lit(1e-9))
        tested = materialize(here.join(total, ["host", "parent"]).select("host", "parent", "node", "level", "n", "bad", "pool_n", "pool_bad", ((rest > 0) & (z >= Z)).alias("apart")), "url-tested")
        none = F.lit(None).cast("long")
        kept.append(tested.where("apart").select("host", "node", "level", "n", "bad", none.alias("host_n"), none.alias("host_bad")))
        given = tested.where("not apart").groupBy("host", F.col("parent").alias("node")).agg(F.sum("pool_n").alias("more_n"), F.sum("pool_bad").alias("more_bad"))
    return materialize(reduce(DataFrame.unionAll, kept), "url-branches")


def judged_templates(pages: DataFrame) -> DataFrame:
    """(host, typed, template, n_labelled, n_bad, merged, purity, blocked) of pages with (host, typed, bad); bad may be null.

    n_labelled and n_bad are those of the branch that judges the template, its nearest kept node; merged if that lies above it.
    """
    leaves = materialize(pages.groupBy("host", "typed").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "url-leaves")
    named = materialize(tree(leaves), "url-tree")
    templates = materialize(leaves.join(named, ["host", "typed"]).groupBy("host", "names").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-names")
    branches = kept_branches(templates)
    nearest = prefixes(templates.select("host", "names")).join(branches.select("host", "node", "n", "bad"), ["host", "node"]).groupBy("host", "names").agg(F.max(F.struct("level", "n", "bad")).alias("by"))
    hosts = branches.where("level = 0").select("host", "host_n", "host_bad")
    every = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_bad").alias("bad")).first()
    whole = templates.select("host", "names").join(nearest, ["host", "names"], "left").join(hosts, "host", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    smooth = lambda bad, n, to: (bad + STRENGTH * to) / (n + STRENGTH)
    base = F.lit(every.bad / every.n if every.n else 0.0)
    own = smooth(count("by.bad"), count("by.n"), smooth(count("host_bad"), count("host_n"), base))
    template = F.concat_ws("", F.transform("names", lambda s: F.concat(F.lit("/"), s)))
    scored = whole.select("host", "names", template.alias("template"), count("by.n").alias("n_labelled"), count("by.bad").alias("n_bad"), (count("by.level") < F.size("names")).alias("merged"), own.alias("purity"), ((own >= BLOCK_AT) & (count("host_n") > 0)).alias("blocked"))
    return named.join(scored, ["host", "names"]).drop("names")


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, template, purity of every page. ``labels``: (page id, bad 0 or 1), any subset, one for
    each id (of several the worst counts)."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("typed", typed(F.col("path")))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.max("bad").cast("long").alias("bad"))
    templates = materialize(judged_templates(parsed.join(known, "id", "left")), "url-templates")
    rule, verdict = rule_of(rules, F.col("host"), F.col("path"))
    out = parsed.join(templates, ["host", "typed"], "left")
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
