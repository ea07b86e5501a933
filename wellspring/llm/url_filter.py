"""URL filters: host and path rules, and a character language-model ratio.  DataFrame functions only.

URLs that a rule settles train two smoothed variable-order Markov models, of accepted and of rejected URLs: characters
after up to two others, each order smoothed by the next lower one in proportion to how many characters were seen after
the context.  A URL without a rule is judged by its mean log-likelihood difference a character; the threshold is
calibrated on settled URLs that training did not see (those whose md5 starts with 0, 1 or 2), between the two kinds'
means by their spread.

URLs are reduced to 46 characters and two marks, so a model has at most 48**3 = 110,592 rows: that is why it may be
broadcast.  Each distinct URL is cut up once, and counts are pre-aggregated.  Log-likelihoods are summed as integers, so
reruns agree to the bit.

Defined cases: host and path of a null URL or one without :// are empty, no rule fits and the whole string is judged;
without settled URLs of both kinds everything is allowed; rows that repeat get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: (verdict, host, path); the longest path and host win.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789./-_?=&#%"
SYMBOLS = len(LETTERS) + 3  # any other, start and end
SCALE = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct of name and verdict of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1:])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        value = F.struct(F.lit(h + p).alias("name"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def reduced(url: Column) -> Column:
    """Two starts, the characters after the scheme, and an end."""
    lower = F.translate(F.coalesce(_after_scheme(url), url, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit("^^"), F.regexp_replace(lower, r"[^a-z0-9./_?=&#%-]", "~"), F.lit("$"))


def language_models(grams: DataFrame) -> DataFrame:
    """grams: (g, a, b): three characters and how often accepted and rejected URLs have them.  Returns (g, llr)."""
    cut = grams.select("g", F.substring("g", 1, 2).alias("c2"), F.substring("g", 2, 2).alias("g2"), F.substring("g", 2, 1).alias("c1"), F.substring("g", 3, 1).alias("g1"), "a", "b")

    def sums(by: str, *more: Column) -> DataFrame:
        return cut.groupBy(by).agg(F.sum("a").alias(f"a_{by}"), F.sum("b").alias(f"b_{by}"), *more)

    one = sums("g1")
    # Kinds of character after a context of one or two.
    two = cut.groupBy("c1", "g2").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    after1 = two.groupBy("c1").agg(F.sum("a").alias("a_c1"), F.sum("b").alias("b_c1"), F.count_if(F.col("a") > 0).alias("ka_c1"), F.count_if(F.col("b") > 0).alias("kb_c1"))
    after2 = sums("c2", F.count_if(F.col("a") > 0).alias("ka_c2"), F.count_if(F.col("b") > 0).alias("kb_c2"))
    all_ = {f"{x}_all": F.sum(f"{x}_g1").over(_everything()) for x in "ab"}
    got = cut
    for df, by in ((one.withColumns(all_), "g1"), (two.groupBy("g2").agg(F.sum("a").alias("a_g2"), F.sum("b").alias("b_g2")), "g2"), (after1, "c1"), (after2, "c2")):
        got = got.join(F.broadcast(df), by)  # at most 48**2 rows

    def log_p(x: str) -> Column:
        p0 = (F.col(f"{x}_g1") + 1.0) / (F.col(f"{x}_all") + SYMBOLS)
        p1 = (F.col(f"{x}_g2") + (F.col(f"k{x}_c1") + 1) * p0) / (F.col(f"{x}_c1") + F.col(f"k{x}_c1") + 1)
        return F.log((F.col(x) + (F.col(f"k{x}_c2") + 1) * p1) / (F.col(f"{x}_c2") + F.col(f"k{x}_c2") + 1))

    return got.select("g", F.round((log_p("a") - log_p("b")) * SCALE).cast("long").alias("llr"))


def _everything():
    return Window.partitionBy(F.lit(0))  # over at most 48 rows


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, llr) of every row of pages; llr: millionths a character."""
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = own.groupBy("url").agg(F.count("*").alias("n"))
    urls = urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("r", rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("held", F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin("0", "1", "2"))
    urls = materialize(spark, urls.select("url", "n", "host", "path", "r", "held", reduced(F.col("url")).alias("z")))
    places = F.explode(F.sequence(F.lit(1), F.length("z") - 2))
    cut = urls.select("url", "n", F.col("r.verdict").alias("v"), "held", "z", places.alias("i")).select("url", "n", "v", "held", F.expr("substring(z, i, 3)").alias("g"))
    kind = lambda v: F.sum(F.when((F.col("v") == v) & ~F.col("held"), F.col("n")).otherwise(0))
    grams = materialize(spark, cut.groupBy("g").agg(kind("allow").alias("a"), kind("block").alias("b")))
    model = materialize(spark, language_models(grams))  # at most 48**3 rows
    scored = cut.join(F.broadcast(model), "g").groupBy(F.col("url").alias("u")).agg((F.sum("llr") / F.count("*")).alias("llr"))
    # A null URL is a group of its own here and joins as one.
    judged = materialize(spark, urls.join(scored, F.col("url").eqNullSafe(F.col("u"))).select("url", "n", "host", "path", "r", "held", "llr"))
    held = judged.where("held and r is not null").groupBy("r.verdict").agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("s"), F.count("*").alias("n"))
    at = threshold({r["verdict"]: (r["m"], r["s"]) for r in held.collect()})
    lm = F.lit("allow") if at is None else F.when(F.col("llr") >= at, "allow").otherwise("block")
    verdict = judged.select(F.col("url").alias("u"), "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), lm).alias("verdict"), F.round("llr").cast("long").alias("llr"))
    return own.join(verdict, F.col("url").eqNullSafe(F.col("u"))).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict", "llr")


def threshold(seen: dict[str, tuple[float, float]]) -> float | None:
    """Between the means of the two kinds, nearer to the one with less spread."""
    if set(seen) != {"allow", "block"}:
        return None
    (ma, sa), (mb, sb) = seen["allow"], seen["block"]
    at = (ma * sb + mb * sa) / (sa + sb) if sa + sb > 0 else (ma + mb) / 2
    return round(at, 3)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages").select("page_id", "url"))


def sql(rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[1:]))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in ordered]
    name = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for _, n, c in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits) + " END"
    low = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    p0 = f"(x.{{k}}_g1 + 1.0::DOUBLE) / (x.{{k}}_all + {SYMBOLS})"
    p1 = f"(x.{{k}}_g2 + (x.k{{k}}_c1 + 1) * ({p0})) / (x.{{k}}_c1 + x.k{{k}}_c1 + 1)"
    ln = f"ln((x.{{k}} + (x.k{{k}}_c2 + 1) * ({p1})) / (x.{{k}}_c2 + x.k{{k}}_c2 + 1))"
    count = lambda by: f"SELECT {by}, sum(a) AS a_{by}, sum(b) AS b_{by}, count_if(a > 0) AS ka_{by}, count_if(b > 0) AS kb_{by}"
    return f"""
WITH u AS (SELECT url, count(*) AS n, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages GROUP BY url),
h AS (SELECT *, coalesce({low.format("regexp_extract(r, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path,
  substr(md5(coalesce(url, '')), 1, 1) IN ('0', '1', '2') AS held, '^^' || regexp_replace({low.format("coalesce(r, url, '')")}, '[^a-z0-9./_?=&#%-]', '~', 'g') || '$' AS z FROM u),
j AS (SELECT *, {name} AS rule, {verdict} AS v FROM h),
e AS (SELECT url, n, v, held, z, unnest(range(1, length(z) - 1)) AS i FROM j),
c AS (SELECT url, n, v, held, substr(z, i, 3) AS g FROM e),
g AS (SELECT g, sum(CASE WHEN v = 'allow' AND NOT held THEN n ELSE 0 END) AS a, sum(CASE WHEN v = 'block' AND NOT held THEN n ELSE 0 END) AS b,
  substr(g, 1, 2) AS c2, substr(g, 2, 2) AS g2, substr(g, 2, 1) AS c1, substr(g, 3, 1) AS g1 FROM c GROUP BY g),
t AS (SELECT c1, g2, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
f1 AS (SELECT g1, sum(a) AS a_g1, sum(b) AS b_g1, sum(sum(a)) OVER () AS a_all, sum(sum(b)) OVER () AS b_all FROM g GROUP BY g1),
f2 AS (SELECT g2, sum(a) AS a_g2, sum(b) AS b_g2 FROM t GROUP BY g2),
f3 AS ({count("c1")} FROM t GROUP BY c1), f4 AS ({count("c2")} FROM g GROUP BY c2),
x AS (SELECT * FROM g JOIN f1 USING (g1) JOIN f2 USING (g2) JOIN f3 USING (c1) JOIN f4 USING (c2)),
m AS (SELECT g, CAST(round(({ln.format(k="a")} - {ln.format(k="b")}) * {SCALE}) AS BIGINT) AS llr FROM x),
s AS (SELECT url, sum(llr)::DOUBLE / count(*) AS llr FROM c JOIN m USING (g) GROUP BY url),
d AS (SELECT j.*, s.llr FROM j JOIN s ON j.url IS NOT DISTINCT FROM s.url),
k AS (SELECT avg(llr) FILTER (v = 'allow') AS ma, stddev_pop(llr) FILTER (v = 'allow') AS sa, avg(llr) FILTER (v = 'block') AS mb, stddev_pop(llr) FILTER (v = 'block') AS sb FROM d WHERE held),
w AS (SELECT round(CASE WHEN sa + sb > 0 THEN (ma * sb + mb * sa) / (sa + sb) ELSE (ma + mb) / 2 END, 3) AS cut FROM k)
SELECT p.page_id, d.host, d.path, d.rule, coalesce(d.v, CASE WHEN w.cut IS NULL OR d.llr >= w.cut THEN 'allow' ELSE 'block' END) AS verdict, CAST(round(d.llr) AS BIGINT) AS llr
FROM pages p JOIN d ON p.url IS NOT DISTINCT FROM d.url, w"""
