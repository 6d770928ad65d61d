"""URL filters: written rules, and a tree of path templates for what no rule decides.

Only DataFrame functions.  Steps after the rules, all on counts of (host, shape) and not on rows:

1. A shape is the path with each run of digits as <n>.
2. Per host, level by level, a segment that takes many values under its parent becomes *.
3. Per host and level, sibling branches that agree but for that segment are merged into one with *
   there, each if it has labels and its share of blocked ones doesn't differ from the pooled share
   by more than ``z`` standard errors.
4. The labels are the verdicts of the rules.  A template is rejected if the share of blocked labels,
   smoothed towards that of the same branch on all hosts, and this towards the share of all labels,
   is over ``threshold``.

Cases: a null url, or one without ://, has an empty host and path, fits no rule, and has the verdict
of the empty template.  Rows are never merged; null page_ids stay null.  An empty table gives no
rows; with no label at all, every template is allowed at the default threshold.  Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/"), UrlRule("block", "net", "/fr/"))


@dataclass(frozen=True)
class TemplateTree:
    """depth: levels of the tree; deeper segments are one **.  A segment is variable with
    min_values values at least and one value for max_repeat urls at most."""

    depth: int = 4
    min_values: int = 12
    max_repeat: int = 4
    z: float = 1.0
    strength: float = 4.0
    threshold: float = 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); NULL if none does.  A chain of
    comparisons: meant for rule lists of tens, not thousands."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def templates(nodes: DataFrame, tree: TemplateTree) -> DataFrame:
    """(host, shape, n, labelled, blocked) to the same rows with template."""
    seg = F.filter(F.split("shape", "/"), lambda s: s != "")
    nodes = nodes.withColumns({"seg": seg, "template": F.lit("")})
    for d in range(tree.depth):
        step = F.get(F.col("seg"), F.lit(d))
        seen = nodes.where(step.isNotNull()).groupBy("host", "template").agg((F.count_distinct(step) >= tree.min_values).alias("many"), (F.count_distinct(step) * tree.max_repeat >= F.sum("n")).alias("rare"))
        variable = seen.where("many AND rare").select("host", "template", F.lit("*").alias("star"))
        nodes = nodes.join(variable, ["host", "template"], "left").withColumn("template", F.when(step.isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("star", step)))).drop("star")
        nodes = written(nodes, "level")  # each level reads the one before it twice
    return nodes.withColumn("template", F.when(F.size("seg") > tree.depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))).drop("seg")


def merged(nodes: DataFrame, tree: TemplateTree) -> DataFrame:
    """Templates with similar siblings merged, level by level; branch is the one before merging."""
    nodes = nodes.withColumn("branch", F.col("template"))
    for d in range(tree.depth):
        at = F.split("template", "/")
        star = F.when(F.size(at) > d + 1, F.concat_ws("/", F.slice(at, 1, d + 1), F.lit("*"), F.slice(at, d + 3, 1000))).otherwise(F.col("template"))
        each = nodes.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
        all_ = Window.partitionBy("host", "star")
        pool = (F.sum("b").over(all_) + 1) / (F.sum("l").over(all_) + 2)
        each = each.withColumn("star", star).withColumns({"pool": pool, "branches": F.count(F.lit(1)).over(all_)})
        apart = F.abs((F.col("b") + 2 * F.col("pool")) / (F.col("l") + 2) - F.col("pool"))
        alike = (F.col("branches") > 1) & (F.col("l") > 0) & (apart <= tree.z * F.sqrt(F.col("pool") * (1 - F.col("pool")) / (F.col("l") + 2)))
        nodes = nodes.join(each.select("host", "template", F.when(alike, F.col("star")).otherwise(F.col("template")).alias("next")), ["host", "template"]).withColumn("template", F.col("next")).drop("next")
        nodes = written(nodes, "level")
    return nodes


def verdicts(nodes: DataFrame, tree: TemplateTree) -> DataFrame:
    """host, shape, template, purity (of blocked labels), blocked_template."""
    here = nodes.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    anywhere = nodes.groupBy("branch").agg(F.sum("labelled").alias("tl"), F.sum("blocked").alias("tb"))
    overall = nodes.agg((F.coalesce(F.sum("blocked"), F.lit(0)) + 1).alias("ab"), (F.coalesce(F.sum("labelled"), F.lit(0)) + 2).alias("al"))  # one row
    s = tree.strength
    prior = (F.col("tb") + s * (F.col("ab") / F.col("al"))) / (F.col("tl") + s)
    found = nodes.join(here, ["host", "template"]).join(anywhere, "branch").crossJoin(F.broadcast(overall))
    return found.select("host", "template", "shape", ((F.col("b") + s * prior) / (F.col("l") + s)).alias("purity"))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, tree: TemplateTree = TemplateTree()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (the last two also where a rule decides)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"ruled": first_rule(F.col("host"), F.col("path"), rules), "shape": F.regexp_replace("path", "[0-9]+", "<n>")})
    nodes = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count_if(F.col("ruled.verdict") == "block").alias("blocked"))
    scored = written(verdicts(merged(templates(written(nodes, "shapes"), tree), tree), tree), "templates")
    learned = F.when(F.col("purity") > tree.threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scored, ["host", "shape"], "left").select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", learned).alias("verdict"), "template", "purity")


def op6_url_templates(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_sql(rules: tuple[UrlRule, ...] = RULES, tree: TemplateTree = TemplateTree()) -> str:
    """The same in DuckDB's SQL."""
    order = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in order]
    rule = "CASE " + " ".join(f"{f} '{r.text}'" for f, r in zip(fits, order)) + " END"
    ruled = "CASE " + " ".join(f"{f} '{r.verdict}'" for f, r in zip(fits, order)) + " END"
    sql = [
        "WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT *, {rule} AS rule, {ruled} AS ruled, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape FROM s)",
        "t0 AS (SELECT host, shape, list_filter(string_split(shape, '/'), lambda x: x <> '') AS seg, '' AS template, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM r GROUP BY host, shape)",
    ]
    for d in range(tree.depth):
        sql.append(f"v{d} AS (SELECT host, template FROM t{d} WHERE seg[{d + 1}] IS NOT NULL GROUP BY host, template HAVING count(DISTINCT seg[{d + 1}]) >= {tree.min_values} AND count(DISTINCT seg[{d + 1}]) * {tree.max_repeat} >= sum(n))")
        sql.append(f"t{d + 1} AS (SELECT t.host, shape, seg, CASE WHEN seg[{d + 1}] IS NULL THEN t.template ELSE t.template || '/' || CASE WHEN v.host IS NULL THEN seg[{d + 1}] ELSE '*' END END AS template, n, labelled, blocked FROM t{d} t LEFT JOIN v{d} v ON t.host = v.host AND t.template = v.template)")
    sql.append(f"m0 AS (SELECT host, shape, CASE WHEN len(seg) > {tree.depth} THEN template || '/**' ELSE template END AS template, CASE WHEN len(seg) > {tree.depth} THEN template || '/**' ELSE template END AS branch, labelled, blocked FROM t{tree.depth})")
    for d in range(tree.depth):
        at = "string_split(template, '/')"
        sql.append(f"e{d} AS (SELECT host, template, CASE WHEN len({at}) > {d + 1} THEN array_to_string(list_concat({at}[1:{d + 1}], ['*'], {at}[{d + 3}:]), '/') ELSE template END AS star, sum(labelled) AS l, sum(blocked) AS b FROM m{d} GROUP BY host, template)")
        sql.append(f"p{d} AS (SELECT *, (sum(b) OVER w + 1) / (sum(l) OVER w + 2)::DOUBLE AS pool, count(*) OVER w AS branches FROM e{d} WINDOW w AS (PARTITION BY host, star))")
        sql.append(f"m{d + 1} AS (SELECT m.host, shape, CASE WHEN branches > 1 AND l > 0 AND abs((b + 2 * pool) / (l + 2) - pool) <= {tree.z} * sqrt(pool * (1 - pool) / (l + 2)) THEN star ELSE m.template END AS template, branch, labelled, blocked FROM m{d} m JOIN p{d} p ON m.host = p.host AND m.template = p.template)")
    s = tree.strength
    sql += [
        f"h AS (SELECT host, template, sum(labelled) AS l, sum(blocked) AS b FROM m{tree.depth} GROUP BY host, template)",
        f"a AS (SELECT branch, sum(labelled) AS tl, sum(blocked) AS tb FROM m{tree.depth} GROUP BY branch)",
        "o AS (SELECT coalesce(sum(b), 0) + 1 AS ab, coalesce(sum(l), 0) + 2 AS al FROM h)",
        f"f AS (SELECT m.host, m.shape, m.template, (b + {s}::DOUBLE * ((tb + {s}::DOUBLE * (ab / al::DOUBLE)) / (tl + {s}::DOUBLE))) / (l + {s}::DOUBLE) AS purity FROM m{tree.depth} m JOIN h ON m.host = h.host AND m.template = h.template JOIN a USING (branch) CROSS JOIN o)",
    ]
    return ",\n".join(sql) + f"\nSELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN purity > {tree.threshold} THEN 'block' ELSE 'allow' END) AS verdict, f.template FROM r LEFT JOIN f ON r.host = f.host AND r.shape = f.shape"
