"""URL filter by path-template trees, in DataFrame expressions alone.

Rules of host and path come first; the longest that fits decides.  Other URLs
are judged by templates.  Per host, paths form a tree of segments.  Digits and
hexadecimal identifiers are variable wherever they stand, so paths of one shape
are one row from the start.  Then, level by level, a node with many different
segments becomes a wildcard, and branches of similar labelled purity that do
not differ significantly from each other are merged.  A path's template is its
way through that tree.

A node's purity is the share of good among its labels, smoothed towards its
parent's, a host's towards one half.  So a template without labels has the
purity of the nearest node above it that has some, a host without labels is
allowed, and a template of low purity is rejected.

Labels are whatever the caller has for pages; the pages that rules decide are
the default.  All statistics are sums by (host, template, segment), which
Spark adds up before the shuffle.  Each level ends in a table, which bounds the
plan.  Verdicts of shapes with a large share of all rows, of which there can
be few, are broadcast; the rest are joined by shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

#: (allow or block, host, path): fits the host and its subdomains where the URL's path starts with the rule's.
Rule = tuple[str, str, str]

#: Levels of the tree that are one segment each; the rest of a deeper path is one segment more, whatever its length.
DEPTH = 6

#: A node with at least this many different segments, of at most this many URLs each on average, becomes a wildcard.
BRANCHES, MEAN_URLS = 8, 4

#: A branch needs this many labels to be merged, with others in its band of purity, within so many standard errors.
LABELLED, BANDS, ERRORS = 5, 4, 2.0

#: Smoothed purity below which a template is rejected, and the labels that the parent's purity counts for.
PURITY, PRIOR = 0.4, 2.0

#: A shape of this share of all rows is hot; there are at most ``1 / HOT`` of them.
HOT = 1 / 1024


def parsed(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column; both empty where it is null or has no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return host, path


def ruled(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one; for short lists of rules."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shaped(path: Column) -> Column:
    """The segments of a path, identifiers and numbers replaced by what they are."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    shape = lambda x: F.regexp_replace(F.regexp_replace(x, r"[0-9a-f]{8,}", "<x>"), r"[0-9]+", "<n>")
    return F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), shape(x)).otherwise(x))


def _level(tree: DataFrame, k: int, depth: int) -> DataFrame:
    """``tree`` with the templates and purities of one level more."""
    deeper = F.size("segments") > k
    own = F.col("segments")[k] if k < depth else F.concat_ws("/", F.slice("segments", depth + 1, F.size("segments")))
    tree = tree.withColumn("branch", F.when(deeper, own))
    node = ["host", "template"]
    kinds = tree.groupBy(*node, "branch").agg(F.sum("n").alias("n"), F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("purity").alias("above"))
    labels = F.col("g") + F.col("b")
    kinds = written(kinds.withColumn("band", F.when((labels >= LABELLED) & F.col("branch").isNotNull(), F.floor(F.col("g") / labels * BANDS))))
    nodes = kinds.groupBy(*node).agg(F.count("branch").alias("branches"), F.sum("n").alias("all_n"))
    bands = kinds.filter("band is not null").groupBy(*node, "band").agg(F.sum("g").alias("band_g"), F.sum("b").alias("band_b"))
    kinds = kinds.join(nodes, node).join(bands, [*node, "band"], "left")
    wild = (F.col("branches") >= BRANCHES) & (F.col("all_n") <= MEAN_URLS * F.col("branches"))
    others = F.col("band_g") + F.col("band_b") - labels
    p = F.col("band_g") / (labels + others)
    gap = F.abs(F.col("g") / labels - (F.col("band_g") - F.col("g")) / others)
    alike = F.when(others >= LABELLED, gap <= ERRORS * F.sqrt(p * (1 - p) * (1 / labels + 1 / others)))
    merged = F.concat(F.lit("/~"), F.col("band").cast("string"))
    step = F.when(F.col("branch").isNull(), "").when(wild, "/*").when(F.coalesce(alike, F.lit(False)), merged).otherwise(F.concat(F.lit("/"), F.col("branch")))
    steps = written(kinds.select(*node, "branch", step.alias("step"), "g", "b", "above"))
    pure = (F.sum("g") + PRIOR * F.max("above")) / (F.sum("g") + F.sum("b") + PRIOR)
    sums = steps.groupBy(*node, "step").agg(pure.alias("below"))
    steps = steps.join(sums, [*node, "step"]).select(
        F.col("host").alias("h"), F.col("template").alias("t"), F.col("branch").alias("s"), "step", F.when(F.col("branch").isNull(), F.col("above")).otherwise(F.col("below")).alias("below")
    )
    same = (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & F.col("branch").eqNullSafe(F.col("s"))
    return written(tree.join(steps, same).select("host", "shape", "segments", F.concat("template", "step").alias("template"), F.col("below").alias("purity"), "n", "good", "bad"))


def templates(shapes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``host, shape, template, purity, n`` of ``shapes`` (``host, shape, segments, n, good, bad``)."""
    shapes = written(shapes)
    levels = shapes.agg(F.max(F.size("segments"))).first()[0] or 0
    hosts = shapes.groupBy("host").agg(((F.sum("good") + PRIOR / 2) / (F.sum("good") + F.sum("bad") + PRIOR)).alias("purity"))
    tree = shapes.join(hosts, "host").select("host", "shape", "segments", F.lit("").alias("template"), "purity", "n", "good", "bad")
    for k in range(min(depth + 1, levels)):
        tree = _level(tree, k, depth)
    return tree.select("host", "shape", "template", "purity", "n")


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages`` (``page_id``, ``url``; more columns are ignored).

    ``labels`` (``page_id``, ``good`` 0 or 1) stand in for the rules' verdicts
    as labels.  A URL that is null or has no ``://`` has an empty host and path
    and is judged as those, however long it is.  Without any labels every purity
    is one half and all is allowed.  Rows that repeat are judged each, and count
    each; null ids are kept; an empty table gives no rows.
    """
    host, path = parsed("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    fit = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.select("page_id", "host", "path", fit.alias("fit"), shaped(F.col("path")).alias("segments"))
    rows = rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"), "segments", F.concat_ws("/", "segments").alias("shape"))
    if labels is None:
        marked = rows.withColumn("good", F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0))
    else:
        marks = labels.groupBy("page_id").agg(F.min("good").alias("good"))
        marked = rows.join(marks, "page_id", "left")
    sums = (F.count(F.lit(1)).alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad"))
    judged = written(templates(marked.groupBy("host", "shape", "segments").agg(*sums)))
    total = judged.agg(F.sum("n")).first()[0] or 0
    hot = judged.filter(F.col("n") >= max(1.0, total * HOT)).select("host", "shape", F.col("template").alias("hot_template"), F.col("purity").alias("hot_purity"))
    found = rows.drop("segments").join(F.broadcast(hot), ["host", "shape"], "left")
    # rows of hot shapes have their answer; for the other join they are dealt by a key of their own that meets nothing
    known = F.col("hot_template").isNotNull()
    found = found.withColumn("at_host", F.when(~known, F.col("host"))).withColumn("at_shape", F.when(known, F.xxhash64("page_id", "path").cast("string")).otherwise(F.col("shape")))
    rest = judged.select(F.col("host").alias("at_host"), F.col("shape").alias("at_shape"), F.col("template").alias("own_template"), F.col("purity").alias("own_purity"))
    found = found.join(rest, ["at_host", "at_shape"], "left")
    template, purity = F.coalesce("hot_template", "own_template"), F.coalesce("hot_purity", "own_purity")
    by_method = F.when(purity < PURITY, "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_method).alias("verdict"), template.alias("template"), purity.alias("purity"))


def oracle(rules: list[Rule], depth: int = DEPTH) -> str:
    """The query over ``pages`` with the rules' labels, in DuckDB SQL."""
    case = ["case"]
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        case.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{verdict} {host}{path}'")
    fit = " ".join([*case, "end"])
    sql = f"""
with cut as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages
), named as (
  select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut
), hosted as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') as path from named
), fitted as (
  select *, {fit} as fit, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda x: case when regexp_matches(x, '[0-9]') then
    regexp_replace(regexp_replace(x, '[0-9a-f]{{8,}}', '<x>', 'g'), '[0-9]+', '<n>', 'g') else x end) as segments from hosted
), ruled as materialized (
  select page_id, host, path, split_part(fit, ' ', 2) as rule, split_part(fit, ' ', 1) as by_rule, segments, array_to_string(segments, '/') as shape from fitted
), shapes as materialized (
  select host, shape, segments, count(*) as n, count(*) filter (by_rule = 'allow') as good, count(*) filter (by_rule = 'block') as bad from ruled group by all
), t0 as materialized (
  select host, shape, segments, n, good, bad, '' as template,
    (sum(good) over w + {PRIOR / 2}) / (sum(good) over w + sum(bad) over w + {PRIOR}) as purity
  from shapes window w as (partition by host)
)"""
    for k in range(depth + 1):
        own = f"segments[{k + 1}]" if k < depth else f"array_to_string(segments[{depth + 1}:], '/')"
        sql += f""", s{k} as materialized (
  select *, case when len(segments) > {k} then {own} end as branch from t{k}
), k{k} as materialized (
  select host, template, branch, sum(n) as n, sum(good) as g, sum(bad) as b, max(purity) as above,
    case when sum(good) + sum(bad) >= {LABELLED} and branch is not null then floor(sum(good) / (sum(good) + sum(bad)) * {BANDS}) end as band
  from s{k} group by host, template, branch
), m{k} as materialized (
  select *, count(branch) over w as branches, sum(n) over w as all_n, sum(g) over v as band_g, sum(b) over v as band_b
  from k{k} window w as (partition by host, template), v as (partition by host, template, band)
), j{k} as materialized (
  select host, template, branch, g, b, above, case when branch is null then '' when branches >= {BRANCHES} and all_n <= {MEAN_URLS} * branches then '/*'
    when band is not null and band_g + band_b - g - b >= {LABELLED} and abs(g / (g + b) - (band_g - g) / (band_g + band_b - g - b))
      <= {ERRORS} * sqrt((band_g / (band_g + band_b)) * (1 - band_g / (band_g + band_b)) * (1 / (g + b) + 1 / (band_g + band_b - g - b)))
    then '/~' || cast(cast(band as bigint) as varchar) else '/' || branch end as step from m{k}
), p{k} as materialized (
  select *, case when branch is null then above else (sum(g) over w + {PRIOR} * above) / (sum(g) over w + sum(b) over w + {PRIOR}) end as below
  from j{k} window w as (partition by host, template, step)
), t{k + 1} as materialized (
  select s.host, shape, segments, n, good, bad, s.template || step as template, below as purity from s{k} s join p{k} p
  on s.host = p.host and s.template = p.template and s.branch is not distinct from p.branch
)"""
    return f"""{sql}
select page_id, r.host, path, nullif(r.rule, '') as rule, coalesce(nullif(by_rule, ''), case when purity < {PURITY} then 'block' else 'allow' end) as verdict, template, purity
from ruled r join t{depth + 1} t on r.host = t.host and r.shape = t.shape"""
