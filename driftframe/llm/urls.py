"""URL filters: rules, and a path-template tree for what no rule decides.

Per host, the segments of paths are generalised: digits become a wildcard, and so does a segment that few of
the host's pages have at its depth. The segments then make a tree, from the host down: below each node, branches whose
labels are statistically like those of the other branches together are merged into one wildcard branch, and
so are their subtrees. A page goes by the deepest node on its way that has labels at all: the node's smoothed
share of labels that block decides, so that a branch without labels takes its nearest labelled ancestor's, the host's at last. Labels are the
verdicts of the rules. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm.shared import looked_up, read, saved

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: A segment stays itself if it has so many pages and such a share of the host's pages of its depth.
SUPPORT, SHARE = 2, 0.01
#: Segments from this depth on are one.
DEPTH = 8
#: Branches merge below this z; purity is smoothed by so many labels of this mean; from here a template is rejected.
MERGE_Z, PRIOR, PRIOR_MEAN, REJECT = 1.96, 4.0, 0.1, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """host, A-Z lower-cased, and path; both empty for null or where there is no ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; rules: a short list, tried one after the other."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first: it goes outermost
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _alike(l: Column, b: Column, pl: Column, pb: Column) -> Column:
    """Whether a branch's share b of l labels is like that of its siblings, pl and pb being the sums with its own."""
    sl, sb, pooled = pl - l, pb - b, pb / pl
    z = F.abs(b / l - sb / sl) / F.sqrt(pooled * (1 - pooled) * (1 / l + 1 / sl))
    # equal shares (0 of 0 spread) are alike; without labels on either side there is nothing to compare
    return F.when((l > 0) & (sl > 0), F.when((pb == 0) | (pb == pl), True).otherwise(z < MERGE_Z)).otherwise(False)


def _generalised(shapes: DataFrame) -> DataFrame:
    """shapes with segs, the segments of shape: those that few of the host's pages have at their depth are wildcards."""
    split = F.split("shape", "/")
    segs = F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))))
    tail = F.array_join(F.slice("segs", DEPTH, F.greatest(F.size("segs"), F.lit(1))), "/")
    cut = F.when(F.size("segs") > DEPTH, F.concat(F.slice("segs", 1, DEPTH - 1), F.array(tail))).otherwise(F.col("segs"))
    shapes = shapes.withColumn("segs", segs).withColumn("segs", cut)
    each = shapes.select("host", "shape", "n", F.posexplode("segs").alias("depth", "segment"))
    support = each.groupBy("host", "depth", "segment").agg(F.sum("n").alias("support"))
    total = each.groupBy("host", "depth").agg(F.sum("n").alias("total"))
    kept = support.join(total, ["host", "depth"]).where((F.col("support") >= SUPPORT) & (F.col("support") >= SHARE * F.col("total"))).select("host", "depth", "segment", F.lit(True).alias("stays"))
    named = each.join(kept, ["host", "depth", "segment"], "left").select("host", "shape", F.struct("depth", F.when(F.col("stays"), F.col("segment")).otherwise("*").alias("segment")).alias("s"))
    made = named.groupBy("host", "shape").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["segment"]).alias("segs"))  # at most DEPTH of a shape
    return shapes.drop("segs").join(made, ["host", "shape"], "left").withColumn("segs", F.coalesce("segs", F.array().cast("array<string>")))


def _tree(shapes: DataFrame) -> DataFrame:
    """(host, shape, template, judged): the leaf of each shape, and the verdict of the deepest labelled node above it."""
    rows = _generalised(shapes).select("host", "shape", "l", "b", "segs", F.array(F.lit("")).alias("nodes"))
    rows = saved(rows, "segments")
    for d in range(1, (rows.agg(F.max(F.size("segs"))).first()[0] or 0) + 1):
        rows = rows.withColumns({"node": F.element_at("nodes", -1), "seg": F.try_element_at("segs", F.lit(d))})
        kids = rows.where("seg is not null").groupBy("host", "node", "seg").agg(F.sum("l").alias("sl"), F.sum("b").alias("sb"))
        sums = kids.groupBy("host", "node").agg(F.sum("sl").alias("pl"), F.sum("sb").alias("pb"))
        like = _alike(F.col("sl"), F.col("sb"), F.col("pl"), F.col("pb"))
        moved = kids.join(sums, ["host", "node"]).select("host", "node", "seg", F.concat("node", F.lit("/"), F.when(like, "*").otherwise(F.col("seg"))).alias("to"))
        nodes = F.when(F.col("to").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("to")))
        rows = saved(rows.join(moved, ["host", "node", "seg"], "left").select("host", "shape", "l", "b", "segs", nodes.alias("nodes")), "level")
    ways = rows.select("host", "shape", "l", "b", F.element_at("nodes", -1).alias("template"), F.posexplode("nodes").alias("depth", "node"))
    stats = ways.groupBy("host", "node").agg(F.sum("l").alias("nl"), F.sum("b").alias("nb"))
    above = ways.join(stats, ["host", "node"])
    found = above.groupBy("host", "shape", "template").agg(F.max_by(F.struct("nl", "nb"), F.when(F.col("nl") > 0, F.col("depth"))).alias("x"))
    share = (F.coalesce("x.nb", F.lit(0)) + PRIOR * PRIOR_MEAN) / (F.coalesce("x.nl", F.lit(0)) + PRIOR)
    return found.select("host", "shape", "template", F.when(share >= REJECT, "block").otherwise("allow").alias("judged"))


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for each row of pages (page_id, url, ...).

    Null urls, and those without ://, have an empty host and path and are judged like others: an empty
    host is a host of its own. A host without labels allows. Rows repeat as in the input; other columns are not looked at.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruled"))
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "*"))
    # the tree is made of one row for each host and shape, not of pages
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("l"), F.count_if(F.col("ruled") == "block").alias("b"))
    shapes = saved(shapes, "shapes")
    judged = saved(_tree(shapes).join(shapes.select("host", "shape", "n"), ["host", "shape"]), "judged")
    return looked_up(rows, judged, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filtered(read(spark, sf_dir, "pages"))


def _rule_sql(column: str) -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))]
    return f"CASE {' '.join(cases)} END"


def _level_sql(d: int) -> str:
    alike = f"""sl > 0 AND pl - sl > 0 AND (pb = 0 OR pb = pl OR
    abs(sb / sl - (pb - sb) / (pl - sl)) / sqrt(pb / pl * (1 - pb / pl) * (1.0::DOUBLE / sl + 1.0::DOUBLE / (pl - sl))) < {MERGE_Z})"""
    return f"""), k{d} AS MATERIALIZED (
  SELECT host, n{d - 1} AS node, segs[{d}] AS seg, sum(l)::DOUBLE AS sl, sum(b)::DOUBLE AS sb FROM t{d - 1} WHERE len(segs) >= {d} GROUP BY ALL
), m{d} AS MATERIALIZED (
  SELECT host, node, seg, node || '/' || CASE WHEN {alike} THEN '*' ELSE seg END AS moved
  FROM (SELECT *, sum(sl) OVER (PARTITION BY host, node) AS pl, sum(sb) OVER (PARTITION BY host, node) AS pb FROM k{d})
), t{d} AS MATERIALIZED (
  SELECT t.*, m.moved AS n{d} FROM t{d - 1} t LEFT JOIN m{d} m ON t.host = m.host AND t.n{d - 1} = m.node AND t.segs[{d}] = m.seg
"""


OP6_SQL = rf"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS ruled, regexp_replace(path, '[0-9]+', '*', 'g') AS shape FROM u
), s1 AS (
  SELECT host, shape, count(*) AS n, count(ruled) AS l, count(*) FILTER (WHERE ruled = 'block') AS b, CASE WHEN shape = '' THEN [] ELSE string_split(shape, '/')[2:] END AS raw FROM r GROUP BY ALL
), shapes AS (
  SELECT * REPLACE (CASE WHEN len(raw) > {DEPTH} THEN list_concat(raw[1:{DEPTH - 1}], [array_to_string(raw[{DEPTH}:], '/')]) ELSE raw END AS raw) FROM s1
), seg AS (
  SELECT host, shape, n, i AS depth, raw[i] AS segment FROM shapes, unnest(range(1, len(raw) + 1)) AS t(i)
), kept AS (
  SELECT host, depth, segment FROM (SELECT host, depth, segment, sum(n) AS support FROM seg GROUP BY ALL) JOIN (SELECT host, depth, sum(n) AS total FROM seg GROUP BY ALL) USING (host, depth)
  WHERE support >= {SUPPORT} AND support >= {SHARE} * total
), made AS (
  SELECT host, shape, list(CASE WHEN k.segment IS NULL THEN '*' ELSE seg.segment END ORDER BY depth) AS segs FROM seg LEFT JOIN kept k USING (host, depth, segment) GROUP BY host, shape
), t0 AS MATERIALIZED (
  SELECT host, shape, l, b, coalesce(segs, []) AS segs, '' AS n0 FROM shapes LEFT JOIN made USING (host, shape)
{"".join(_level_sql(d) for d in range(1, DEPTH + 1))}), ways AS (
  SELECT host, shape, l, b, i AS depth, nodes[i] AS node, nodes[len(segs) + 1] AS template
  FROM (SELECT *, [{", ".join(f"n{d}" for d in range(DEPTH + 1))}] AS nodes FROM t{DEPTH}), unnest(range(1, len(segs) + 2)) AS t(i)
), stats AS (SELECT host, node, sum(l) AS nl, sum(b) AS nb FROM ways GROUP BY ALL
), judged AS (
  SELECT host, shape, template, CASE WHEN (coalesce(arg_max(nb, depth) FILTER (WHERE nl > 0), 0) + {PRIOR * PRIOR_MEAN}) / (coalesce(arg_max(nl, depth) FILTER (WHERE nl > 0), 0) + {PRIOR}) >= {REJECT}
    THEN 'block' ELSE 'allow' END AS judged
  FROM ways JOIN stats USING (host, node) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(ruled, judged) AS verdict, template FROM r JOIN judged USING (host, shape)
"""
