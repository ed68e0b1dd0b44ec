"""URL filter by a tree of path templates, with DataFrame functions only.

Per host the paths of labelled and unlabelled pages form a tree. Level by level the rare values of a segment
that takes many of them under its parent become a wildcard; then, level by level, sibling branches whose labelled
shares of bad pages do not differ significantly are merged into one branch and share what is below. A
template is rejected when its smoothed share of bad pages is high: (bad + prior share * strength) /
(labelled + strength). Explicit rules go first, the longest that fits.

Cases: a null url, or one without "://", has an empty host and path, no rule, and the verdict of the
template of that host. Null labels count as unlabelled. Repeated rows count and come back each.
An empty table gives no rows; without labels nothing is rejected. Columns of the input that are
not named here are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import stored

# (rule, verdict): fixed by the contract
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LEAST_VALUES = 8      # fewer different values are branches, not a variable
FEW_PATHS = 5         # a value with at most so many paths is rare
MANY_VALUES = 24      # and so is one with less than this part of its parent's paths
DIFFERENT = 4.0       # z score from which the labels of a rare value keep it a branch
STRENGTH = 10.0       # of the prior, in labelled pages
SIMILAR = 1.96        # z score up to which branches count as alike
LEAST_LABELS = 5      # branches with fewer are compared together, not each by itself
REJECT = 0.5


def host_of(url: Column) -> Column:
    """Between the first "://" and /, ?, # or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts alike."""
    found = F.lit(None).cast("string")
    # later tests win, so the longest comes last; equal lengths keep the order given
    for rule, _ in sorted(reversed(list(rules)), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, rule).otherwise(found)
    return found


def shape(segment: Column) -> Column:
    """What a wildcard keeps of a segment: its file ending, and whether it is a number."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem == "", "").when(stem.rlike(r"^\d+$"), "<num>").otherwise("<any>")
    return F.concat(kind, ending)


def template_tree(paths: DataFrame, least_values: int = LEAST_VALUES,
                  few_paths: int = FEW_PATHS, many_values: int = MANY_VALUES) -> DataFrame:
    """paths(host, path, ...; bad if there are labels) with template: all segments, variable ones as
    wildcards. Levels go on until no path has a further segment that could be variable.

    Everything is counted in different paths, so repeated pages change nothing. A value is rare if it holds at most
    `few_paths` of its parent's paths, or less than one in `many_values`, however many pages are below it. Rare
    values are variable where there are `least_values` of them; common ones stay branches, and so does a
    rare one with enough labels of its own that differ clearly from the rest.
    """
    bad = F.max("bad") if "bad" in paths.columns else F.lit(None).cast("int")
    parts = F.split(F.regexp_replace("path", r"^/", ""), "/")
    rows = stored(paths.groupBy("host", "path").agg(bad.alias("_bad")), "url-paths").withColumn("_rest", parts).withColumn("template", F.lit(""))
    done = []
    while True:
        # below a parent with fewer paths than least_values no segment at any level is variable
        parents = stored(_steps(rows, ["host", "template"]), "url-parents")
        here = rows.join(parents, ["host", "template"]).select(
            "host", "path", "_bad", (F.col("n") >= least_values).alias("_open"), F.concat_ws("/", "template", F.slice("_rest", 1, F.col("_skip"))).alias("template"),
            F.slice("_rest", F.col("_skip") + 1, F.size("_rest")).alias("_rest")).withColumn("_segment", F.get("_rest", F.lit(0)))
        values = stored(here.where("_open").groupBy("host", "template", "_segment").agg(
            F.count("*").alias("c"), F.count("_bad").alias("l"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("b")), "url-values")
        variable = stored(_variable(values, least_values, few_paths, many_values), "url-variable")
        rest, ends = F.slice("_rest", 2, F.size("_rest")), F.size("_rest") == 1
        piece = F.when(F.col("_variable"), shape(F.col("_segment"))).otherwise(F.col("_segment"))
        whole = ~F.col("_open") & ~ends
        after = stored(here.join(variable, ["host", "template", "_segment"], "left").select(
            "host", "path", "_bad", rest.alias("_rest"), (ends | whole).alias("_done"),
            F.concat("template", F.lit("/"), piece, F.when(whole, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise("")).alias("template")), "url-level")
        done.append(after.where("_done").select("host", "path", "template"))
        rows = after.where("NOT _done").drop("_done")
        if rows.isEmpty():
            break
    return paths.join(functools.reduce(DataFrame.unionByName, done), ["host", "path"])


def _steps(rows: DataFrame, parent: list[str], node: tuple[str, ...] = (), also: str = "true") -> DataFrame:
    """Per parent: n rows, and _skip, the number of leading segments of _rest that divide none of its nodes; one is left.

    The least and the greatest list share what all lists share, so a chain of only children is one step of any length.
    """
    found = rows.groupBy(*parent, *node).agg(F.count("*").alias("n"), F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"),
                                             (F.min(F.size("_rest")) - 1).alias("_most"))
    alike = F.expr(f"transform(sequence(0, _most), i -> i < _most AND get(_lo, i) = get(_hi, i) AND {also})")
    found = found.select(*parent, "n", (F.array_position(alike, F.lit(False)) - 1).cast("int").alias("_skip"))
    return found.groupBy(*parent).agg(F.sum("n").alias("n"), F.min("_skip").alias("_skip")) if node else found


def _variable(values: DataFrame, least_values: int, few_paths: int, many_values: int) -> DataFrame:
    """values(host, template, _segment, c paths, l labelled and b bad ones): those that become wildcards."""
    parents = values.groupBy("host", "template").agg(
        F.sum("c").alias("n"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"), F.count("*").alias("values"))
    values = values.join(parents.where(F.col("values") >= least_values), ["host", "template"])
    rest_l, p = F.col("all_l") - F.col("l"), F.col("all_b") / F.greatest("all_l", F.lit(1))
    gap = F.abs(F.col("b") / F.greatest("l", F.lit(1)) - (F.col("all_b") - F.col("b")) / F.greatest(rest_l, F.lit(1)))
    clear = (F.col("l") >= STRENGTH) & (rest_l > 0) & (gap > DIFFERENT * F.sqrt(p * (1 - p) * (1 / F.greatest("l", F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1)))))
    rare = ((F.col("c") <= few_paths) | (F.col("c") * many_values < F.col("n"))) & ~clear
    values = values.where(rare).select("host", "template", "_segment")
    enough = values.groupBy("host", "template").agg(F.count("*").alias("k")).where(F.col("k") >= least_values).select("host", "template")
    return values.join(enough, ["host", "template"], "left_semi").withColumn("_variable", F.lit(True))


def _groups(nodes: DataFrame, similar: float) -> DataFrame:
    """nodes(host, up, leaf, kind, l, b) with group, groups: siblings in order of their bad share, cut where the
    next one differs (two-sample z test) from all of the group so far. Equal counts are one entry, and so
    are all siblings with too few labels, so a parent's list is bounded by its labels, not by its children."""
    key = ["host", "up", "leaf"]
    entries = nodes.groupBy(*key, "kind").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.max("l").alias("own_l"), F.max("b").alias("own_b"))
    few = F.col("kind") == "few"
    item = F.struct("l", "b", F.when(few, F.col("l")).otherwise(F.col("own_l")).alias("n"),
                    F.when(few, F.col("b")).otherwise(F.col("own_b")).alias("k"), "kind")
    lists = entries.groupBy(*key).agg(F.collect_list(item).alias("items"), (F.sum("b") / F.greatest(F.sum("l"), F.lit(1))).alias("all"))
    # what has no label stands at the share of all
    lists = lists.withColumn("items", F.expr(
        "array_sort(transform(items, x -> struct(if(x.l = 0, all, x.b / x.l) AS share, x.kind AS kind, x.l AS l, x.b AS b, x.n AS n, x.k AS k)))"))
    pooled = "((s.b + x.k) / greatest(s.l + x.n, 1))"
    alike = (f"(s.l = 0 OR x.n = 0 OR abs(x.k / greatest(x.n, 1) - s.b / greatest(s.l, 1)) <= "
             f"{similar}D * sqrt({pooled} * (1 - {pooled}) * (1 / greatest(s.l, 1) + 1 / greatest(x.n, 1))) + 1e-12D)")
    cuts = F.expr(
        "aggregate(items, named_struct('at', 0, 'l', 0L, 'b', 0L, 'cuts', cast(array() AS array<int>)), (s, x) -> "
        f"if({alike}, named_struct('at', s.at + 1, 'l', s.l + x.l, 'b', s.b + x.b, 'cuts', s.cuts), "
        "named_struct('at', s.at + 1, 'l', x.l, 'b', x.b, 'cuts', concat(s.cuts, array(s.at)))), s -> s.cuts)")
    placed = lists.withColumn("cuts", cuts).select(*key, "cuts", F.posexplode("items.kind").alias("at", "kind"))
    return nodes.join(placed.select(*key, "kind", F.expr("size(filter(cuts, c -> c <= at))").alias("group"),
                                    (F.size("cuts") + 1).alias("groups")), [*key, "kind"])


def merged_branches(templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """templates(host, template, pages, labelled, bad) with branch: siblings with a like bad share are one branch.

    Level by level, whole branches (with all pages below them) are compared with their siblings; what is
    below merged branches has one parent then and is compared again where it divides. A merged branch is named ~, with
    its number if its parent has several groups; an inner branch that is like no other keeps its name, and so
    does a template unless it is alone under its parent.
    """
    parts = F.split("template", "/")
    rows = templates.withColumn("_rest", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).withColumn(
        "up", F.lit("")).withColumn("_node", F.lit(""))
    done = [rows.where(F.size("_rest") == 0).withColumn("branch", F.col("template"))]
    rows = rows.where(F.size("_rest") > 0)
    merged = F.contains("up", F.lit("/~"))
    while not rows.isEmpty():
        steps = stored(_steps(rows, ["host", "up"], ("_node",), "(contains(up, '/~') OR NOT startswith(get(_lo, i), '~'))"), "url-steps")
        here, skip = rows.join(steps, ["host", "up"]), F.col("_skip")
        # a template that is alone has nothing to be compared with, however deep it goes
        done.append(here.where("n = 1").withColumn("branch", F.concat_ws("/", "up", F.slice("_rest", 1, F.size("_rest") - 1), F.lit("~"))))
        here = stored(here.where("n > 1").select(
            *templates.columns, (F.size("_rest") == skip + 1).alias("leaf"),
            F.concat_ws("/", "up", F.when(merged, F.array_repeat(F.lit("~"), skip)).otherwise(F.slice("_rest", 1, skip))).alias("up"),
            F.concat_ws("/", "_node", F.slice("_rest", 1, skip + 1)).alias("_node"),
            F.slice("_rest", skip + 2, F.size("_rest")).alias("_rest")), "url-nodes")
        key = ["host", "up", "leaf", "_node"]
        nodes = here.groupBy(*key).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).withColumn(
            "kind", F.when(F.col("l") < LEAST_LABELS, "few").otherwise(F.concat_ws("/", "l", "b")))
        grouped = _groups(nodes, similar)
        last = F.element_at(F.split("_node", "/"), -1)  # under merged branches it names several nodes
        members = grouped.groupBy("host", "up", "leaf", "group").agg(F.count("*").alias("_members"))
        named = grouped.join(members, ["host", "up", "leaf", "group"]).select(
            *key, F.when((F.col("_members") == 1) & ~(F.col("leaf") & (F.col("groups") == 1)) & ~merged
                         & ~F.startswith(last, F.lit("~")), last)
            .when(F.col("groups") == 1, "~").otherwise(F.concat(F.lit("~"), F.col("group"))).alias("_name"))
        after = stored(here.join(named, key).withColumn("up", F.concat("up", F.lit("/"), "_name")), "url-branches")
        done.append(after.where("leaf").withColumn("branch", F.col("up")))
        rows = after.where("NOT leaf").select(rows.columns)
    return functools.reduce(DataFrame.unionByName, [d.select(*templates.columns, "branch") for d in done])


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, strength: float = STRENGTH, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch, purity for every page.

    labels(page_id, bad): bad is 1 or 0. Labels that repeat a page are averaged to the worst.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    worst = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = rows.join(worst, "page_id", "left")
    rows = stored(template_tree(rows), "url-templates")
    templates = rows.groupBy("host", "template").agg(
        F.count("*").alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    branches = merged_branches(stored(templates, "url-counts"))
    sums = branches.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    prior = rows.agg((F.coalesce(F.sum("bad"), F.lit(0)) / F.greatest(F.count("bad"), F.lit(1))).alias("prior"))
    prior = prior.first()["prior"]  # one number
    scored = sums.select("host", "branch", ((F.col("b") + F.lit(prior * strength)) / (F.col("l") + strength)).alias("purity"))
    known = branches.select("host", "template", "branch").join(scored, ["host", "branch"])
    rule = rule_for(F.col("host"), F.col("path"), rules)
    return rows.join(known, ["host", "template"], "left").withColumn("rule", rule).select(
        "page_id", "host", "path", "rule",
        F.when(F.col("rule").isNotNull(), F.get(F.array(*[F.lit(v) for _, v in rules]), F.array_position(F.array(*[F.lit(r) for r, _ in rules]), F.col("rule")).cast("int") - 1))
        .when(F.col("purity") >= reject, "block").otherwise("allow").alias("verdict"),
        "template", "branch", "purity")
