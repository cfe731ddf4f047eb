"""URL filters by a path-template tree, in DataFrame functions only.

Rules (host, path) decide what they fit and so label those urls. Per host, paths become templates: a segment
with a digit is a variable, and so is one that fewer than `support` urls of the host have below the same parent.
Levels go on until no path has a deeper segment; a path that has ended leaves the loop with its estimate.

Purity is the labelled rate of allowed urls. At each node of a host's tree the branches are put in order of their
rates, and neighbours that do not differ by more than `z` standard errors of the difference of two rates are merged: a
merged branch pools the labels of all its members. If its rate does not differ from the parent's estimate by more than
`z` standard errors it takes that; otherwise its own rate, smoothed with `prior` urls of the parent's estimate. Branches
without labels take the parent's. Above a host's tree stands the rate of all urls. A url that no rule fits is allowed if
its template's estimate is at least `purity`.

Cases: a null url, or one without ://, has an empty host and path and that empty host's verdict; with no labelled
url the estimate is 1/2; repeated urls count as often as they occur; an empty table gives no rows; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path); fixed values.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(raw) + 1, F.length(rest))
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    return F.coalesce(*(F.when(f, h + p) for f, (_, h, p) in zip(fits, ordered))), F.coalesce(*(F.when(f, v) for f, (v, _, _) in zip(fits, ordered)))


def _estimate(n: Column, allowed: Column, parent: Column, z: float, prior: float) -> Column:
    """A branch's estimate from its labels and its parent's estimate."""
    differs = F.abs(allowed / n - parent) > z * F.sqrt(parent * (1 - parent) / n)
    return F.when((n > 0) & differs, (allowed + prior * parent) / (n + prior)).otherwise(parent)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules=RULES, support: int = 3, z: float = 2.0, prior: float = 4.0, purity: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("u"))
    host, path = host_and_path(F.col("u"))
    rows = base.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"/+", "/"), r"/$", ""), r"[^/]*[0-9][^/]*", "{n}")
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), shape.alias("shape"))
    # one row for each host and shape from here on
    kinds = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("ruled").alias("m"), F.count_if(F.col("ruled") == "allow").alias("a"))

    def level(df: DataFrame) -> DataFrame:
        """Replace e, the parent's estimate, by that of the merged branch; parent `up`, branch t."""
        branches = df.groupBy("host", "up", "t").agg(F.sum("m").alias("bm"), F.sum("a").alias("ba"), F.max("e").alias("up_e"))
        branches = branches.withColumn("rate", F.when(F.col("bm") > 0, F.col("ba") / F.col("bm")))
        # branches of one rate are alike, so a node has a row for each rate and not for each branch
        rates = branches.where("bm > 0").groupBy("host", "up", "rate").agg(F.sum("bm").alias("rm"), F.sum("ba").alias("ra"), F.max("up_e").alias("up_e"))
        by_rate = Window.partitionBy("host", "up").orderBy("rate")
        before = lambda c: F.lag(c).over(by_rate)
        pooled = (before("ra") + F.col("ra")) / (before("rm") + F.col("rm"))
        differs = F.col("rate") - before("rate") > z * F.sqrt(pooled * (1 - pooled) * (1 / before("rm") + 1 / F.col("rm")))
        rates = rates.withColumn("new", F.coalesce(differs, F.lit(False)).cast("int")).withColumn("merged", F.sum("new").over(by_rate))
        whole = Window.partitionBy("host", "up", "merged")
        rates = rates.withColumn("own", _estimate(F.sum("rm").over(whole), F.sum("ra").over(whole), F.col("up_e"), z, prior)).select("host", "up", "rate", "own")
        named = branches.select("host", "up", "t", "rate").join(rates, ["host", "up", "rate"]).select("host", "up", "t", "own")
        # steps are written: each is read twice by the next, and a host of many paths can be split at run time
        named = materialize(named, "url-branches")
        return materialize(df.join(named, ["host", "up", "t"], "left").withColumn("e", F.coalesce("own", "e")).drop("own"), "url-tree")

    def general(df: DataFrame, k: int) -> DataFrame:
        """Add segment k, or what stands for it, to the template t; up is the one without."""
        df = df.drop("up").withColumn("s", F.split_part("shape", F.lit("/"), F.lit(k + 1)))
        seen = materialize(df.groupBy("host", "t", "s").agg(F.sum("n").alias("support")), "url-support")
        name = F.when(F.col("s").isin("", "{n}") | (F.col("support") >= support), F.col("s")).otherwise("*")
        named = df.join(seen, ["host", "t", "s"]).withColumnRenamed("t", "up")
        return materialize(named.withColumn("t", F.when((F.lit(k) > 1) & (name == ""), F.col("up")).otherwise(F.concat("up", F.lit("/"), name))).drop("s", "support"), "url-tree")

    kinds = materialize(kinds, "url-kinds")
    whole = kinds.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.coalesce(F.sum("a"), F.lit(0)).alias("a")).select(F.when(F.col("m") > 0, (F.col("a") + prior / 2) / (F.col("m") + prior)).otherwise(0.5).alias("e0"))
    hosts = kinds.groupBy("host").agg(F.sum("m").alias("bm"), F.sum("a").alias("ba")).join(F.broadcast(whole))  # one row
    hosts = materialize(hosts.select("host", _estimate(F.col("bm"), F.col("ba"), F.col("e0"), z, prior).alias("e")), "url-hosts")
    tree = kinds.join(hosts, "host").withColumn("t", F.lit(""))
    depth = F.size(F.split("shape", "/")) - 1
    tree = level(general(tree, 1))
    ended, k = [], 2
    while True:
        tree = level(general(tree, k))
        ended.append(tree.where(depth < k))
        tree = tree.where(depth >= k)
        if not tree.head(1):
            break
        k += 1
    judged = reduce(DataFrame.union, ended).select("host", "shape", F.col("t").alias("template"), F.when(F.col("e") >= purity, "allow").otherwise("block").alias("judged"))
    return rows.join(judged, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(levels: int = 4) -> str:
    """The DuckDB form; paths deeper than `levels` - 1 segments are judged at the last level."""
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"
    est = lambda m, a, e: f"CASE WHEN {m} > 0 AND abs({a}::double / {m} - {e}) > 2.0::double * sqrt({e} * (1 - {e}) / {m}) THEN ({a}::double + 4.0::double * {e}) / ({m}::double + 4.0::double) ELSE {e} END"
    steps = [f"l0 AS (SELECT k.host, shape, len(string_split(shape, '/')) - 1 AS depth, n, m, a, h.e, '' AS t FROM kinds k JOIN hosts h USING (host))"]
    for k in range(1, levels + 1):
        live = "" if k < 3 else f" WHERE depth >= {k - 1}"
        name = "CASE WHEN s IN ('', '{n}') OR sum(n) OVER (PARTITION BY host, t, s) >= 3 THEN s ELSE '*' END"
        steps += [
            f"s{k} AS (SELECT *, split_part(shape, '/', {k + 1}) AS s FROM l{k - 1}{live})",
            f"t{k} AS (SELECT host, shape, depth, n, m, a, e, t AS up, CASE WHEN {k} > 1 AND nm = '' THEN t ELSE t || '/' || nm END AS t FROM (SELECT *, {name} AS nm FROM s{k}))",
            f"b{k} AS (SELECT host, up, t, sum(m) AS bm, sum(a) AS ba, max(e) AS e, CASE WHEN sum(m) > 0 THEN sum(a)::double / sum(m) END AS rate FROM t{k} GROUP BY host, up, t)",
            f"r{k} AS (SELECT host, up, rate, sum(bm) AS rm, sum(ba) AS ra, max(e) AS e FROM b{k} WHERE bm > 0 GROUP BY host, up, rate)",
            f"o{k} AS (SELECT *, lag(rate) OVER w AS p, lag(rm)  OVER w AS pm, (lag(ra) OVER w + ra)::double / (lag(rm) OVER w + rm) AS q FROM r{k} WINDOW w AS (PARTITION BY host, up ORDER BY rate))",
            f"c{k} AS (SELECT *, sum(CASE WHEN rate - p > 2.0::double * sqrt(q * (1 - q) * (1.0::double / pm + 1.0::double / rm)) THEN 1 ELSE 0 END) OVER (PARTITION BY host, up ORDER BY rate) AS merged FROM o{k})",
            f"m{k} AS (SELECT host, up, rate, e, sum(rm) OVER w AS mm, sum(ra) OVER w AS ma FROM c{k} WINDOW w AS (PARTITION BY host, up, merged))",
            f"e{k} AS (SELECT b.host, b.up, b.t, {est('mm', 'ma', 'x.e')} AS own FROM b{k} b JOIN m{k} x ON b.host = x.host AND b.up = x.up AND b.rate = x.rate)",
            f"l{k} AS (SELECT t.host, shape, depth, n, m, a, coalesce(own, e) AS e, t.t FROM t{k} t LEFT JOIN e{k} y ON t.host = y.host AND t.up = y.up AND t.t = y.t)",
        ]
    ended = " UNION ALL ".join(["SELECT host, shape, t, e FROM l2 WHERE depth < 2"] + [f"SELECT host, shape, t, e FROM l{k} WHERE depth = {k - 1}" for k in range(3, levels)] + [f"SELECT host, shape, t, e FROM l{levels} WHERE depth >= {levels - 1}"])
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
q AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled,
 regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', ''), '[^/]*[0-9][^/]*', '{{n}}', 'g') AS shape FROM p),
kinds AS (SELECT host, shape, count(*) AS n, count(ruled) AS m, count(*) FILTER (WHERE ruled = 'allow') AS a FROM q GROUP BY host, shape),
root AS (SELECT CASE WHEN sum(m) > 0 THEN (sum(a)::double + 2.0::double) / (sum(m)::double + 4.0::double) ELSE 0.5::double END AS e0 FROM kinds),
hosts AS (SELECT host, {est('bm', 'ba', 'e0')} AS e FROM (SELECT host, sum(m) AS bm, sum(a) AS ba FROM kinds GROUP BY host), root),
{", ".join(steps)},
judged AS ({ended})
SELECT q.page_id, q.host, q.path, q.rule, coalesce(q.ruled, CASE WHEN j.e >= 0.5::double THEN 'allow' ELSE 'block' END) AS verdict, j.t AS template
FROM q JOIN judged j ON q.host = j.host AND q.shape = j.shape"""


OP9_SQL = _sql()
