"""Filters of urls: given rules by host and path, and for urls that none fits, association rules mined from labelled urls.

A url is the set of its tokens: scheme, host, last one and last two labels of the host, first label of longer hosts, first
two path segments, extension, query and fragment, at most ten, numbers in the path and the query as `#`. FP-growth mines the
sets of tokens that go along with the label; a rule is such a set, with the number of labelled urls that hold it and the
share of them that are labelled. DataFrame operations only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: (host, path, verdict) of the query.
GIVEN = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Least share of labelled urls and least number of them that hold a mined set and the label; least share of the urls
#: with the set that have the label; most tokens of a set.
SUPPORT, LEAST, CONFIDENCE, MOST_TOKENS = 0.001, 5, 0.5, 3
#: A url has at most ten tokens, so at most 2^10 / SUPPORT mined sets exist, whatever the number of urls.
MOST_RULES = 2**10 * 1000
_LABEL = "!"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_parts(urls: DataFrame) -> DataFrame:
    """urls (id, page_id, url) with host, path and tokens; null urls and urls without `://` have empty ones and no tokens."""
    at = F.instr("url", "://")
    x = urls.withColumn("_rest", F.when(at > 0, F.substr("url", at + 3, F.length("url"))))
    x = x.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0)).withColumn("_tail", F.substr("_rest", F.length("_host") + 1, F.length("_rest")))
    x = x.withColumn("host", _lower(F.coalesce("_host", F.lit("")))).withColumn("path", F.coalesce(F.regexp_extract("_tail", "^[^?#]*", 0), F.lit("")))
    labels, steps = F.split("host", "\\."), F.split("path", "/")
    numbers = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    parts = {
        "s:": _lower(F.substr("url", F.lit(1), at - 1)), "h:": F.col("host"), "t:": F.regexp_extract("host", r"([^.]+)\z", 1), "d:": F.regexp_extract("host", r"([^.]+\.[^.]+)\z", 1),
        "l:": F.when(F.size(labels) > 2, F.get(labels, F.lit(0))), "1:": numbers(F.get(steps, F.lit(1))), "2:": numbers(F.get(steps, F.lit(2))), "x:": F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1),
        "q:": numbers(F.regexp_extract("_tail", r"^[^?#]*\?([^#]*)", 1)), "f:": F.regexp_extract("_tail", r"^[^#]*#([\s\S]*)\z", 1),
    }
    named = F.filter(F.array(*[F.concat(F.lit(k), F.nullif(v, F.lit(""))) for k, v in parts.items()]), lambda t: t.isNotNull())
    return x.withColumn("tokens", F.when(F.col("_rest").isNull(), F.array().cast("array<string>")).otherwise(named)).drop("_rest", "_host", "_tail")


def given_rule(rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as (rule, verdict), else null. A rule fits its host and all subdomains, if the path
    starts with the rule's; of rules of equal length the one that blocks counts."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(place, tokens, hits, n, confidence, key) of the rules that labelled urls (tokens, bad) give, best first.

    n urls hold all tokens, hits of them are bad. Kept are sets with at least `support` of all urls and `least` urls among
    hits, with at least `confidence`, and with a larger share of bad ones than all urls have; a set goes if a part of it is as sure. Best are the surest, then those with
    most hits, then the first by their tokens. key is the rarest token of a rule. No labelled urls give no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    bought = stored(labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(_LABEL))).otherwise(F.col("tokens")).alias("items")))
    n, bad = bought.agg(F.count("*"), F.count_if(F.array_contains("items", _LABEL))).first()
    few = max(least, -(-int(n * support * 1_000_000) // 1_000_000))
    if n < few:
        return labelled.sparkSession.createDataFrame([], "place int, tokens array<string>, hits long, n long, confidence double, key string")
    sets = FPGrowth(itemsCol="items", minSupport=(few - 0.5) / n, minConfidence=1.0).fit(bought).freqItemsets.withColumn("items", F.array_sort("items"))
    sets = stored(sets.filter(F.size("items") <= most_tokens + 1))
    plain = sets.filter(~F.array_contains("items", _LABEL)).select(F.col("items").alias("tokens"), F.col("freq").alias("n"))
    both = sets.filter(F.array_contains("items", _LABEL) & (F.size("items") > 1)).select(F.array_remove("items", _LABEL).alias("tokens"), F.col("freq").alias("hits"))
    rules = both.join(plain, "tokens").withColumn("confidence", F.col("hits") / F.col("n")).filter((F.col("confidence") >= confidence) & (F.col("hits") * n > F.col("n") * bad))
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("tokens")) - 2)
    inside = F.transform(masks, lambda m: F.filter("tokens", lambda t, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1))
    parts = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode(inside).alias("part"))
    surer = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    rules = rules.join(parts.join(surer, "part").filter("sure >= confidence").select("tokens"), "tokens", "left_anti")
    rare = rules.select("tokens", F.explode("tokens").alias("t")).join(plain.filter(F.size("tokens") == 1).select(F.get("tokens", F.lit(0)).alias("t"), F.col("n").alias("m")), "t")
    rules = rules.join(rare.groupBy("tokens").agg(F.min_by("t", F.struct("m", "t")).alias("key")), "tokens")
    # at most MOST_RULES rows, so one window may number them
    return rules.select(F.row_number().over(W.orderBy(F.desc("confidence"), F.desc("hits"), "tokens")).alias("place"), "tokens", "hits", "n", "confidence", "key")


def judged(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = GIVEN) -> DataFrame:
    """One row for every row of urls (page_id, url): page_id, host, path, rule, verdict, and the mined rule that spoke.

    labelled: (url, bad). Where no given rule fits, a url is blocked if a mined rule fits and allowed otherwise; the best
    fitting one is named in `mined`, with its `confidence`. Null and empty urls, and those without `://`, have no tokens, so
    they are allowed. Repeated rows and null ids are judged like others, labelled urls with a null label are left out, an
    empty table gives an empty one, columns other than those named are not read. Urls of any length have at most ten tokens.

    Rules are an inverted index under their rarest token; a url meets only rules whose rarest token it has, and holds a
    rule if no other token of it is missing.
    """
    known = with_parts(labelled.filter(F.col("bad").isNotNull() & F.col("url").isNotNull()).select("url", "bad")).select("tokens", "bad")
    found = stored(mined_rules(known))
    rows = stored(with_parts(urls.select("page_id", "url").withColumn("_row", F.monotonically_increasing_id())).withColumn("_given", given_rule(rules)).drop("url"))
    index = found.select(F.col("key").alias("t"), F.col("tokens").alias("_needs"), "place")
    small = F.broadcast if found.count() <= MOST_RULES else lambda df: df
    asked = rows.filter("_given is null").select("_row", "tokens", F.explode("tokens").alias("t"))
    held = asked.join(small(index), "t").filter(F.size(F.array_except("_needs", "tokens")) == 0).groupBy("_row").agg(F.min("place").alias("place"))
    best = held.join(small(found.select("place", F.array_join("tokens", " ").alias("mined"), "confidence")), "place").drop("place")
    out = rows.join(best, "_row", "left")
    verdict = F.coalesce("_given.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("_given.rule").alias("rule"), verdict.alias("verdict"), "mined", "confidence")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by the given rules and by rules mined from labels; a page is bad if labelled toxic or of quality 0.
    For odd rows see judged; a page whose id has several labels counts once for each."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return judged(pages, pages.join(labels, "page_id").select("url", "bad"))


_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(GIVEN, key=lambda r: -len(r[0] + r[1])))
SQL = rf"""
WITH a AS (SELECT row_number() OVER () AS id, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT *, substr(rest, length(raw) + 1) AS tail, translate(coalesce(raw, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host FROM b),
d AS (SELECT *, coalesce(regexp_extract(tail, '^[^?#]*'), '') AS path FROM c),
e AS (SELECT id, page_id, host, path, CASE WHEN rest IS NULL THEN [] ELSE list_sort(list_filter([
  's:' || nullif(translate(substr(url, 1, instr(url, '://') - 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), ''), 'h:' || nullif(host, ''), 't:' || nullif(regexp_extract(host, '([^.]+)\z', 1), ''),
  'd:' || nullif(regexp_extract(host, '([^.]+\.[^.]+)\z', 1), ''), 'l:' || CASE WHEN len(string_split(host, '.')) > 2 THEN nullif(string_split(host, '.')[1], '') END,
  '1:' || nullif(regexp_replace(string_split(path, '/')[2], '[0-9]+', '#', 'g'), ''), '2:' || nullif(regexp_replace(string_split(path, '/')[3], '[0-9]+', '#', 'g'), ''),
  'x:' || nullif(regexp_extract(path, '\.([A-Za-z0-9]+)\z', 1), ''), 'q:' || nullif(regexp_replace(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '[0-9]+', '#', 'g'), ''),
  'f:' || nullif(regexp_extract(tail, '^[^#]*#([\s\S]*)\z', 1), '')], lambda t: t IS NOT NULL)) END AS tokens, CASE {_CASES} END AS given FROM d),
known AS (SELECT row_number() OVER () AS k, tokens, (toxic = 1 OR quality = 0) AS bad FROM e JOIN labels ON doc_id = page_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.id = e.id AND a.url IS NOT NULL)),
one AS (SELECT k, bad, unnest(tokens) AS t FROM known),
sets AS (SELECT bad, [t] AS s FROM one UNION ALL SELECT x.bad, [x.t, y.t] FROM one x JOIN one y ON x.k = y.k AND x.t < y.t
  UNION ALL SELECT x.bad, [x.t, y.t, z.t] FROM one x JOIN one y ON x.k = y.k AND x.t < y.t JOIN one z ON x.k = z.k AND y.t < z.t),
counted AS (SELECT s, count(*) FILTER (bad) AS hits, count(*) AS n FROM sets GROUP BY 1),
sure AS (SELECT s, hits, n, hits / n AS confidence FROM counted WHERE hits >= greatest({LEAST}, (SELECT ceil(count(*) * {SUPPORT}) FROM known)) AND hits / n >= {CONFIDENCE} AND hits * (SELECT count(*) FROM known) > n * (SELECT count(*) FILTER (bad) FROM known)),
rules AS (SELECT row_number() OVER (ORDER BY confidence DESC, hits DESC, s) AS place, * FROM sure r WHERE NOT EXISTS (SELECT 1 FROM sure p WHERE len(p.s) < len(r.s) AND list_has_all(r.s, p.s) AND p.confidence >= r.confidence)),
best AS (SELECT id, min(place) AS place FROM e JOIN rules ON list_has_all(tokens, s) WHERE given IS NULL GROUP BY 1)
SELECT page_id, host, path, split_part(given, '|', 1) AS rule, coalesce(split_part(given, '|', 2), CASE WHEN place IS NULL THEN 'allow' ELSE 'block' END) AS verdict, array_to_string(s, ' ') AS mined, confidence
FROM e LEFT JOIN best USING (id) LEFT JOIN rules USING (place)"""
