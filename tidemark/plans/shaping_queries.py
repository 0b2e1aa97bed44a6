"""Queries on names, reshaping, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import month, quarter_stamp
from tidemark.operators import panel, vintage
from tidemark.plans.queries import _GRID, BY, QS, query, rounded
from tidemark.testbed import daily, meta, obs, read, target

_MONTH = "CAST(date_trunc('month', {}) AS DATE)"
AS_OF = "2001-06-17"


def lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "lineitem").withColumn("date", month("l_shipdate"))


_LINES = f", lines AS (SELECT *, {_MONTH.format('l_shipdate')} AS date FROM lineitem)"


@query("p01_clean_names", " SELECT DISTINCT p_name AS series, replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 'widget', 'wdg') AS clean FROM part")
def p01(s, d):
    clean = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), "^_|_$", "")
    return read(s, d, "part").select(F.col("p_name").alias("series"), F.replace(clean, F.lit("widget"), F.lit("wdg")).alias("clean")).distinct()


@query("p02_renamed", " SELECT coalesce('R' || substr(m.ticket, 2), o.ticket) AS ticket, date, value FROM obs o LEFT JOIN (SELECT ticket FROM meta WHERE months_lag < 5) m USING (ticket) WHERE o.ticket IS NOT NULL")
def p02(s, d):
    """Registered series get their ticket; others keep their name."""
    known = meta(s, d).filter("months_lag < 5").select("ticket", F.concat(F.lit("R"), F.expr("substr(ticket, 2)")).alias("new"))
    return obs(s, d).filter("ticket is not null").join(known, "ticket", "left").select(F.coalesce("new", "ticket").alias("ticket"), "date", "value")


_RAW = "CASE l_linenumber WHEN 1 THEN 'n.d.' WHEN 2 THEN '<1' WHEN 3 THEN '(' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ')' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@query("p04_sentinels", f" SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN 0.0 WHEN 3 THEN -round(CAST(CAST(l_quantity AS INTEGER) AS DOUBLE), 0) ELSE round(CAST(CAST(l_quantity AS INTEGER) AS DOUBLE), 0) END AS value, {_RAW} AS raw FROM lineitem")
def p04(s, d):
    x = read(s, d, "lineitem").withColumn("raw", F.expr(_RAW.replace("VARCHAR", "STRING")))
    value = F.when(F.col("raw").isin("n.d.", "n.a."), None).when(F.col("raw") == "<1", 0.0).otherwise(F.expr("try_cast(regexp_replace(raw, '^\\\\((.*)\\\\)$', '-$1') as double)"))
    return x.select("l_orderkey", "l_linenumber", "raw", value.alias("value"))


@query("p06_melted", f", w AS (SELECT ticket, {QS} AS date, min(value) AS low, max(value) AS high FROM obs GROUP BY 1, 2) SELECT ticket, date, 'low' AS kind, low AS value FROM w UNION ALL SELECT ticket, date, 'high', high FROM w")
def p06(s, d):
    return panel.quarter_range(obs(s, d)).unpivot(["ticket", "date"], ["low", "high"], "kind", "value")


@query("p08_pivot_mean", " SELECT date, round(avg(value) FILTER (agg_method = 'mean'), 6) AS mean, round(avg(value) FILTER (agg_method = 'last'), 6) AS last, round(avg(value) FILTER (agg_method = 'sum'), 6) AS sum FROM obs JOIN meta USING (ticket) GROUP BY 1")
def p08(s, d):
    """Several series of one method fall on one cell: their mean."""
    x = obs(s, d).join(meta(s, d), "ticket").groupBy("date").pivot("agg_method", ["mean", "last", "sum"]).agg(F.avg("value"))
    return rounded(x, "mean", "last", "sum")


@query("p09_zero_missing", _LINES + " SELECT l_suppkey, date, nullif(sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END), 0) AS value FROM lines GROUP BY 1, 2")
def p09(s, d):
    return lines(s, d).groupBy("l_suppkey", "date").agg(F.nullif(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)), F.lit(0)).alias("value"))


@query("p10_whole_months", f" SELECT ticket, date, value FROM obs WHERE date < date_trunc('month', DATE '{AS_OF}')")
def p10(s, d):
    return obs(s, d).filter(F.col("date") < F.trunc(F.to_date(F.lit(AS_OF)), "MM"))


@query("p11_composite", " SELECT date, round(avg(value), 6) AS value FROM obs WHERE ticket IN (SELECT ticket FROM meta WHERE months_lag = 2) GROUP BY 1")
def p11(s, d):
    return rounded(obs(s, d).join(meta(s, d).filter("months_lag = 2"), "ticket", "left_semi").groupBy("date").agg(F.avg("value").alias("value")), "value")


@query("p12_converted", _LINES + ", fx AS (SELECT date, 1 + avg(l_tax) AS rate FROM lines GROUP BY 1), v AS (SELECT date, s_nationkey, sum(CASE l_returnflag WHEN 'R' THEN l_extendedprice ELSE 0 END) AS v FROM lines JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 10 GROUP BY 1, 2) SELECT date, round(nullif(sum(v * rate), 0), 2) AS total FROM v JOIN fx USING (date) GROUP BY 1")
def p12(s, d):
    """Partner values in another currency, added up; a total of zero is missing."""
    x = lines(s, d)
    fx = x.groupBy("date").agg((1 + F.avg("l_tax")).alias("rate"))
    v = x.join(read(s, d, "supplier").filter("s_nationkey < 10"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("date", "s_nationkey")
    v = v.agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)).alias("v"))
    return v.join(fx, "date").groupBy("date").agg(F.round(F.nullif(F.sum(F.col("v") * F.col("rate")), F.lit(0)), 2).alias("total"))


@query("p13_balances", _LINES + ", p AS (SELECT date, sum(l_quantity) FILTER (l_linestatus = 'O') AS o, sum(l_quantity) FILTER (l_linestatus = 'F') AS f FROM lines GROUP BY 1) SELECT date, o - f AS surplus, o - f + 0.5 * f AS balance FROM p")
def p13(s, d):
    p = lines(s, d).groupBy("date").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return p.select("date", (F.col("O") - F.col("F")).alias("surplus"), (F.col("O") - F.col("F") + 0.5 * F.col("F")).alias("balance"))


@query("p14_recoded", " SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status FROM orders")
def p14(s, d):
    names = F.create_map(*[F.lit(x) for x in ("F", "final", "O", "open", "P", "partial")])
    return read(s, d, "orders").select("o_orderkey", names[F.col("o_orderstatus")].alias("status"))


@query("p15_families", " SELECT ticket, date, value FROM obs WHERE ticket = 'S0000003' OR ticket NOT LIKE 'S000000%'")
def p15(s, d):
    """One series of a family stays, its relatives go."""
    return obs(s, d).filter((F.col("ticket") == "S0000003") | ~F.col("ticket").startswith("S000000"))


@query("p16_start_cut", " SELECT ticket, date, value FROM obs WHERE date >= (SELECT min(date) - INTERVAL 2 MONTH FROM target WHERE y IS NOT NULL AND date >= DATE '1996-01-01')")
def p16(s, d):
    first = target(s, d).filter("y is not null and date >= date'1996-01-01'").agg(F.add_months(F.min("date"), -2).alias("first"))  # one row
    return obs(s, d).join(F.broadcast(first), F.col("date") >= F.col("first")).drop("first")


@query("p19_flags", " SELECT sector, site, date, CASE WHEN value < 50 THEN 'low' WHEN value < 150 THEN 'middle' ELSE 'high' END AS level, CASE WHEN value >= 150 THEN 1 ELSE 0 END AS alert FROM daily")
def p19(s, d):
    v = F.col("value")
    return daily(s, d).select("sector", "site", "date", F.when(v < 50, "low").when(v < 150, "middle").otherwise("high").alias("level"), F.when(v >= 150, 1).otherwise(0).alias("alert"))


@query("p22_subset", " SELECT ticket, months_lag FROM meta WHERE regexp_matches(ticket, '^S0+[0-9]*[05]$')")
def p22(s, d):
    return meta(s, d).filter(F.col("ticket").rlike("^S0+[0-9]*[05]$")).select("ticket", "months_lag")


@query("p24_underscored", ", c AS (SELECT replace(p_name, ' ', '_') AS name, min(p_brand) AS brand FROM part WHERE p_size < 25 GROUP BY 1) SELECT p_partkey, coalesce(brand, replace(p_name, ' ', '_')) AS series FROM part LEFT JOIN c ON name = replace(p_name, ' ', '_')")
def p24(s, d):
    p = read(s, d, "part").withColumn("name", F.replace("p_name", F.lit(" "), F.lit("_")))
    known = p.filter("p_size < 25").groupBy("name").agg(F.min("p_brand").alias("brand"))
    return p.join(known, "name", "left").select("p_partkey", F.coalesce("brand", "name").alias("series"))


_ORD = f"(SELECT {_MONTH.format('o_orderdate')} AS date, count(*) AS orders FROM orders GROUP BY 1)"


def order_months(s, d):
    return read(s, d, "orders").groupBy(month("o_orderdate").alias("date")).agg(F.count("*").alias("orders"))


@query("j01_full_join", _LINES + f" SELECT date, orders, n FROM {_ORD} FULL JOIN (SELECT date, count(*) AS n FROM lines GROUP BY 1) USING (date)")
def j01(s, d):
    return order_months(s, d).join(lines(s, d).groupBy("date").agg(F.count("*").alias("n")), "date", "full")


@query("j02_inner_join", f", q AS (SELECT {QS} AS date, sum(value) AS total FROM obs GROUP BY 1) SELECT date, y, total FROM target JOIN q USING (date)")
def j02(s, d):
    """Both sides get the same stamp first; stamps of quarter starts would match nothing."""
    return target(s, d).join(obs(s, d).groupBy(quarter_stamp("date").alias("date")).agg(F.sum("value").alias("total")), "date")


@query("j03_left_join", ", m AS (SELECT date, sum(value) AS total FROM obs GROUP BY 1) SELECT date, total, y FROM m LEFT JOIN target USING (date)")
def j03(s, d):
    return obs(s, d).groupBy("date").agg(F.sum("value").alias("total")).join(target(s, d), "date", "left")


@query("j04_metadata", ", p AS (SELECT ticket, count(*) AS n FROM obs WHERE ticket NOT LIKE '%7' GROUP BY 1) SELECT ticket, n, months_lag, agg_method FROM p FULL JOIN (SELECT * FROM meta WHERE ticket NOT LIKE '%3') m USING (ticket)")
def j04(s, d):
    p = obs(s, d).filter("ticket not like '%7'").groupBy("ticket").agg(F.count("*").alias("n"))
    return p.join(meta(s, d).filter("ticket not like '%3'"), "ticket", "full").select("ticket", "n", "months_lag", "agg_method")


@query("j07_semi", " SELECT ticket, date, value FROM obs WHERE ticket IN (SELECT ticket FROM meta WHERE nominal = 1)")
def j07(s, d):
    return obs(s, d).join(meta(s, d).filter("nominal = 1"), "ticket", "left_semi")


@query("j08_known", _GRID + f", k AS (SELECT o.ticket, o.date, o.value, {QS.replace('date)', 'o.date)')} AS quarter, months_lag FROM obs o JOIN meta USING (ticket)) SELECT ticket, quarter, vintage, max(k.date) AS last_known, max_by(value, k.date) AS value FROM k JOIN g ON g.date = quarter AND k.date + to_months(months_lag) <= g.date + to_months(vintage) GROUP BY 1, 2, 3")
def j08(s, d):
    """What of a quarter is published at each reading: the last known month and its value."""
    k = obs(s, d).join(meta(s, d), "ticket").withColumn("quarter", quarter_stamp("date"))
    x = k.withColumn("vintage", F.explode(F.array(*map(F.lit, vintage.VINTAGES)))).join(target(s, d).select(F.col("date").alias("quarter")), "quarter", "left_semi")
    x = x.filter(F.add_months("date", F.col("months_lag")) <= F.add_months("quarter", F.col("vintage")))
    return x.groupBy("ticket", "quarter", "vintage").agg(F.max("date").alias("last_known"), F.max_by("value", "date").alias("value"))


@query("j11_grid", _GRID + " SELECT date, vintage, agg_method FROM g, (SELECT DISTINCT agg_method FROM meta)")
def j11(s, d):
    """Quarters x vintages x groups: a grid of small tables."""
    g = target(s, d).select("date", F.explode(F.array(*map(F.lit, vintage.VINTAGES))).alias("vintage"))
    return g.crossJoin(F.broadcast(meta(s, d).select("agg_method").distinct()))  # three groups


@query("j13_lagged_join", " SELECT a.ticket, a.date, a.value, b.value AS lag1, c.value AS lag2 FROM obs a LEFT JOIN obs b ON b.ticket = a.ticket AND b.date = a.date - INTERVAL 1 MONTH LEFT JOIN obs c ON c.ticket = a.ticket AND c.date = a.date - INTERVAL 2 MONTH")
def j13(s, d):
    o = obs(s, d)
    out = o
    for k in (1, 2):
        out = out.join(o.select("ticket", F.add_months("date", k).alias("date"), F.col("value").alias(f"lag{k}")), ["ticket", "date"], "left")
    return out


@query("j16_tiles", ", b AS (SELECT s_suppkey, s_suppkey * 37 % 348 - 180 AS lon, 78 - s_suppkey * 53 % 156 AS lat FROM supplier) SELECT s_suppkey, CAST(h AS INTEGER) AS h, CAST(v AS INTEGER) AS v FROM b, unnest(range(CAST(floor((lon + 180) / 10) AS BIGINT), CAST(floor((lon + 12 + 180) / 10) AS BIGINT) + 1)) AS x(h), unnest(range(CAST(floor((90 - lat - 12) / 10) AS BIGINT), CAST(floor((90 - lat) / 10) AS BIGINT) + 1)) AS y(v)")
def j16(s, d):
    """Ten-degree tiles that the bounding box of each place touches; a box spans 12 degrees."""
    k = F.col("s_suppkey")
    b = read(s, d, "supplier").select("s_suppkey", (k * 37 % 348 - 180).alias("lon"), (78 - k * 53 % 156).alias("lat"))
    at = lambda x: F.floor((x) / 10).cast("int")
    b = b.withColumn("h", F.explode(F.sequence(at(F.col("lon") + 180), at(F.col("lon") + 192))))
    return b.withColumn("v", F.explode(F.sequence(at(78 - F.col("lat")), at(90 - F.col("lat"))))).select("s_suppkey", "h", "v")


@query("t02_lowest_month", " SELECT ticket, date, value FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY value, date) AS r FROM obs) WHERE r = 1")
def t02(s, d):
    return obs(s, d).groupBy("ticket").agg(F.min(F.struct("value", "date")).alias("x")).select("ticket", "x.date", "x.value")


@query("t03_order", " SELECT date, ticket, CAST(row_number() OVER (PARTITION BY date ORDER BY value DESC, ticket) AS INTEGER) AS place FROM obs")
def t03(s, d):
    return obs(s, d).select("date", "ticket", F.row_number().over(W.partitionBy("date").orderBy(F.desc("value"), "ticket")).alias("place"))


@query("w18_top", " SELECT agg_method, date, ticket, rank FROM (SELECT agg_method, date, ticket, CAST(row_number() OVER (PARTITION BY agg_method, date ORDER BY value DESC, ticket) AS INTEGER) AS rank FROM obs JOIN meta USING (ticket)) WHERE rank <= 3")
def w18(s, d):
    best = W.partitionBy("agg_method", "date").orderBy(F.desc("value"), "ticket")
    return obs(s, d).join(meta(s, d), "ticket").select("agg_method", "date", "ticket", F.row_number().over(best).alias("rank")).filter("rank <= 3")


@query("u01_union", " SELECT 'flat' AS design, ticket, date, value FROM obs UNION ALL SELECT 'quarter', ticket, date, round(value, 6) FROM qobs")
def u01(s, d):
    a = obs(s, d).select(F.lit("flat").alias("design"), "ticket", "date", "value")
    return a.unionByName(panel.to_quarter(obs(s, d), meta(s, d)).select(F.lit("quarter").alias("design"), "ticket", "date", F.round("value", 6).alias("value")))


_SCREENS = ", st AS (SELECT ticket, count(*) AS n, round(avg(value), 6) AS m, round(stddev_samp(value), 6) AS sd FROM obs GROUP BY 1), sc AS (SELECT 'n' AS method, ticket, row_number() OVER (ORDER BY n DESC, ticket) AS r FROM st UNION ALL SELECT 'm', ticket, row_number() OVER (ORDER BY m DESC, ticket) FROM st UNION ALL SELECT 'sd', ticket, row_number() OVER (ORDER BY sd DESC, ticket) FROM st)"


@query("u02_consensus", _SCREENS + " SELECT ticket, count(DISTINCT method) AS methods, CAST(sum(r) AS BIGINT) AS ranks, count(DISTINCT method) = 3 AS in_all FROM sc WHERE r <= 40 GROUP BY 1 HAVING count(DISTINCT method) >= 2")
def u02(s, d):
    """Series among the first 40 of all three screens, or of all but one, with their summed ranks."""
    st = obs(s, d).groupBy("ticket").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("value"), 6).alias("m"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    long = st.unpivot("ticket", ["n", "m", "sd"], "method", "score")
    top = long.withColumn("r", F.row_number().over(W.partitionBy("method").orderBy(F.desc("score"), "ticket"))).filter("r <= 40")
    out = top.groupBy("ticket").agg(F.count_distinct("method").alias("methods"), F.sum("r").alias("ranks"))
    return out.filter("methods >= 2").withColumn("in_all", F.col("methods") == 3)


@query("u03_difference", " SELECT DISTINCT site, date FROM daily WHERE sector = 'view' EXCEPT SELECT site, date FROM daily WHERE sector = 'click'")
def u03(s, d):
    x = daily(s, d)
    return x.filter("sector = 'view'").select("site", "date").subtract(x.filter("sector = 'click'").select("site", "date"))


@query("f01_strings", " SELECT p_partkey, lower(trim(p_name)) AS low, replace(p_name, ' ', '-') AS dashed, regexp_extract(p_brand, '([0-9]+)', 1) AS number, starts_with(p_name, 'c') AS with_c, split_part(p_name, ' ', 2) AS second, concat_ws('|', p_brand, p_type) AS joined FROM part")
def f01(s, d):
    return read(s, d, "part").select(
        "p_partkey", F.lower(F.trim("p_name")).alias("low"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("dashed"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"),
        F.col("p_name").startswith("c").alias("with_c"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.concat_ws("|", "p_brand", "p_type").alias("joined"),
    )


@query("f02_slugs", " SELECT DISTINCT source, regexp_replace(regexp_replace(translate(lower(source), 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM documents WHERE source IS NOT NULL")
def f02(s, d):
    plain = F.translate(F.lower("source"), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    return read(s, d, "documents").filter("source is not null").select("source", F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_|_$", "").alias("slug")).distinct()


@query("f03_dates", f" SELECT o_orderkey, {QS.replace('date)', 'o_orderdate)')} AS stamp, CAST(date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS months, CAST(date_trunc('month', o_orderdate) + INTERVAL 4 MONTH AS DATE) AS later, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(strftime(o_orderdate, '%y%j') AS VARCHAR) AS julian FROM orders")
def f03(s, d):
    t = F.col("o_orderdate").cast("date")
    return read(s, d, "orders").select(
        "o_orderkey", quarter_stamp("o_orderdate").alias("stamp"), ((F.year(t) - 1995) * 12 + F.month(t) - 1).cast("int").alias("months"), F.add_months(F.trunc(t, "MM"), 4).alias("later"),
        F.month(t).alias("m"), F.quarter(t).alias("q"), F.date_format(t, "yyDDD").alias("julian"),
    )


@query("f04_math", " SELECT ticket, date, round(sqrt(abs(value - 100)), 6) AS root, round(ln(value + 1), 6) AS log, round(pow(value / 100, 2), 6) AS square, CAST(ceil(value / 7) AS BIGINT) AS up, greatest(least(value, 120), 30) AS clipped FROM obs")
def f04(s, d):
    v = F.col("value")
    return obs(s, d).select("ticket", "date", F.round(F.sqrt(F.abs(v - 100)), 6).alias("root"), F.round(F.log(v + 1), 6).alias("log"), F.round(F.pow(v / 100, F.lit(2)), 6).alias("square"), F.ceil(v / 7).alias("up"), F.greatest(F.least(v, F.lit(120.0)), F.lit(30.0)).alias("clipped"))


@query("f06_arrays", _SCREENS + ", l AS (SELECT ticket FROM sc WHERE method = 'n' AND r <= 10 UNION SELECT ticket FROM sc WHERE method = 'm' AND r <= 10) SELECT ticket FROM l")
def f06(s, d):
    """The union of two lists, each cut to its first ten, as rows."""
    st = obs(s, d).groupBy("ticket").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("m"))
    lists = [st.orderBy(F.desc(c), "ticket").limit(10).agg(F.slice(F.collect_list("ticket"), 1, 10).alias(c)) for c in ("n", "m")]
    return lists[0].crossJoin(lists[1]).select(F.explode(F.array_union("n", "m")).alias("ticket"))


@query("f07_json", " SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def f07(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("f08_nulls", f", w AS (SELECT ticket, date, value, lag(value) {BY} AS before FROM obs) SELECT ticket, date, coalesce(before, value) AS filled, nullif(value, before) AS changed, before IS NULL AS first, CASE WHEN before > 50 THEN value END AS masked FROM w")
def f08(s, d):
    w = obs(s, d).withColumn("before", F.lag("value").over(W.partitionBy("ticket").orderBy("date")))
    return w.select("ticket", "date", F.coalesce("before", "value").alias("filled"), F.nullif(F.col("value"), F.col("before")).alias("changed"), F.col("before").isNull().alias("first"), F.when(F.col("before") > 50, F.col("value")).alias("masked"))
