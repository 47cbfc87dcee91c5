"""URL filters by association rules, in DataFrame functions only.

Every labelled url becomes a basket of tokens (host labels, path segments, extension, query keys, scheme) and its class.
FP-growth mines the frequent token combinations; rules whose consequent is the blocked class are pruned by confidence
and support. An inverted index from token to rules, dealt into hash buckets, finds the rules of a url: a rule matches
when as many of the url's tokens point to it as it has tokens. Explicit (host, path) rules come before the mined ones.

Urls are mined and matched by all their tokens. The mined rules are collected: a frequent token stands in min_support of the baskets, so there are at most as many as an average basket has tokens, over
min_support, whatever the number of pages. Null urls and urls without ``://`` have empty host and path and no tokens; they are allowed. Without labels of the
blocked class no rule is mined. Repeated rows count and give a row each, an empty table none; only page_id and url are read, other columns, clashing names included, are left behind.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "class=block"
BUCKETS = 256


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


EXPLICIT = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))


def parsed(pages: DataFrame) -> DataFrame:
    """Adds host, path and ``_rest``, what follows ``://``."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    return (
        pages.withColumn("_rest", rest)
        .withColumn("host", F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), CAPITALS, SMALL))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
    )


def tokens() -> Column:
    """All distinct tokens of a parsed url; numbers count as one token."""
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), x))
    present = lambda parts: F.filter(parts, lambda x: x != "")
    query = F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    segments = F.transform(present(F.split("path", "/")), lambda s: F.regexp_replace(s, "[0-9]+", "0"))
    found = F.concat(
        tagged("h:", present(F.split("host", r"\."))),
        tagged("p:", segments),
        tagged("q:", present(F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1)))),
        tagged("s:", present(F.array(F.when(F.col("_rest") != "", F.substring_index("url", "://", 1)).otherwise("")))),
    )
    return F.array_distinct(found)


def mined(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_count: int = 3, min_lift: float = 2.0, max_tokens: int = 3) -> list[tuple[list[str], float, float]]:
    """(tokens, confidence, support) of the rules of at most ``max_tokens`` tokens for the blocked class (quality 0), most confident first.

    Confidence is judged against the share of blocked urls among the labelled ones: ``min_lift`` times it or, where that is much, half way from it to 1.
    """
    low = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("low"))
    baskets = parsed(pages.select("page_id", "url")).filter("_rest <> ''").join(low, "page_id").select("low", F.when(F.col("low"), F.array_append(tokens(), F.lit(BLOCKED))).otherwise(tokens()).alias("items"))
    n, blocked = baskets.agg(F.count("*"), F.count_if("low")).head()
    if not blocked:
        return []
    support = min(1.0, max(min_support, min_count / n))
    often = baskets.filter("low").select(F.explode("items").alias("t")).groupBy("t").count().filter(F.col("count") >= support * n * (1 - 1e-9))
    frequent = [r.t for r in often.collect()]  # a rule's tokens each stand in so many blocked urls: nothing else can be in one
    baskets = baskets.select(F.filter("items", lambda t: t.isin(frequent)).alias("items"))
    least = min(min_lift * blocked / n, (1 + blocked / n) / 2) * (1 - 1e-9)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=least).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BLOCKED))) & (F.size("antecedent") <= max_tokens))
    found = [(sorted(r.antecedent), r.confidence, r.support) for r in rules.select("antecedent", "confidence", "support").collect()]
    return sorted(found, key=lambda r: (-r[1], -r[2], r[0]))


def blocked_by(rules: list[tuple[list[str], float, float]]) -> Column:
    """Whether a mined rule matches column ``_tokens``."""
    if not rules:
        return F.lit(False)
    table: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for k, (antecedent, _, _) in enumerate(rules):
        for t in antecedent:
            table[zlib.crc32(t.encode()) % BUCKETS].setdefault(t, []).append(k)
    index = F.from_json(F.lit(json.dumps([[{"t": t, "r": r} for t, r in b.items()] for b in table])), "array<array<struct<t: string, r: array<int>>>>")
    sizes = F.from_json(F.lit(json.dumps([len(a) for a, _, _ in rules])), "array<int>")
    postings = F.flatten(F.transform("_tokens", lambda t: F.flatten(F.transform(F.filter(F.get(index, (F.crc32(t.cast("binary")) % BUCKETS).cast("int")), lambda e: e["t"] == t), lambda e: e["r"]))))
    hit = lambda found: F.exists(F.array_distinct(found), lambda r: F.size(F.filter(found, lambda x: x == r)) == F.get(sizes, r))
    return F.coalesce(F.transform(F.array(postings), hit)[0], F.lit(False))


def judged(pages: DataFrame, mined_rules: list[tuple[list[str], float, float]], explicit: tuple[UrlRule, ...] = EXPLICIT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; the longest explicit rule that fits wins, else the mined rules judge."""
    rule = verdict = None
    for r in sorted(explicit, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    method = F.when(blocked_by(mined_rules), "block").otherwise("allow")
    rows = parsed(pages.select("page_id", "url")).withColumn("_tokens", tokens())
    return rows.select("page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (method if verdict is None else F.coalesce(verdict, method)).alias("verdict"))


SQL = """WITH u AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT rid, page_id, list_distinct(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
  || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g'))
  || list_transform(list_filter(list_transform(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)
  || CASE WHEN rest <> '' THEN ['s:' || string_split(url, '://')[1]] ELSE [] END) AS ts FROM p),
low AS (SELECT doc_id AS page_id, min(quality) = 0 AS low FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT t.rid, low, ts FROM t JOIN low USING (page_id) WHERE len(ts) > 0),
n AS (SELECT ceil(greatest(0.002, 3 / greatest(count(*), 1)) * count(*) - 1e-9) AS least, count(*) AS n, count(*) FILTER (low) AS lows FROM lab),
one AS (SELECT rid, unnest(ts) AS a FROM t), lone AS (SELECT rid, low, unnest(ts) AS a FROM lab),
sets AS (SELECT rid, low, [a] AS s FROM lone UNION ALL SELECT x.rid, x.low, [x.a, y.a] FROM lone x JOIN lone y ON x.rid = y.rid AND x.a < y.a
  UNION ALL SELECT x.rid, x.low, [x.a, y.a, z.a] FROM lone x JOIN lone y ON x.rid = y.rid AND x.a < y.a JOIN lone z ON x.rid = z.rid AND y.a < z.a),
rules AS (SELECT s FROM sets, n GROUP BY s, least, n, lows HAVING count(*) FILTER (low) >= least AND 2 * n * count(*) FILTER (low) >= least(4 * lows, n + lows) * count(*)),
r AS (SELECT row_number() OVER () AS k, s FROM rules), ri AS (SELECT k, len(s) AS m, unnest(s) AS a FROM r),
hit AS (SELECT DISTINCT rid FROM (SELECT rid, k FROM one JOIN ri USING (a) GROUP BY rid, k, m HAVING count(*) = m)),
j AS (SELECT p.*, hit.rid IS NOT NULL AS mined, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM p LEFT JOIN hit USING (rid))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN mined THEN 'block' ELSE 'allow' END AS verdict FROM j"""
