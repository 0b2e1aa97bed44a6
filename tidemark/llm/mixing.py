"""Mix sources to target weights with hash-threshold histograms.

Each document has a fixed 60-bit hash. A source's budget is met by taking the documents below a hash threshold; larger
budgets take supersets of smaller ones. The threshold comes from sums of words by (source, hash bucket): the bucket in
which the running sum passes the budget is split into 4096 finer ones, and so on until it holds one document. No row is
sorted, and only one row per source comes to the driver at each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST, LEVELS, BITS = 1.5, 2, 5, 12
#: Sources (of some 100 bytes each) up to which a budget is broadcast.
BROADCAST = 20_000


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """Target words of each source. Sources in order of code points, null last, weigh as in weights, repeating; they
    share `share` times all words by weight; what is above `most` times a source's words is shared again by weight
    among the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in names if s in open_ and left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.remove(s)
        left -= sum(out[s] for s in over)
    return out


def measured(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words) and hash of every document, stored. Equal rows have equal hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored(
        docs.select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), *extra,
            F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"),
            F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64(text)), 4).alias("hash"),
        )
    )


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, copies (whole copies of every document), low and high (hashes
    below low get one more copy; those from low to below high share `rest` words), edge (documents in that range)."""
    spark = sized.sparkSession
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    aim = targets(sizes, weights, share, most)
    state = {s: {"copies": int(aim[s] // n) if n else 0, "prefix": 0, "edge": 0} for s, n in sizes.items()}
    for s, x in state.items():
        x["rest"] = int(round(aim[s])) - x["copies"] * sizes[s]
    schema = "source string, prefix long, rest long"
    bits = LEVELS * BITS
    for level in range(LEVELS):
        bits -= BITS
        now = spark.createDataFrame([(s, x["prefix"], x["rest"]) for s, x in state.items()], schema)
        same = sized["source"].eqNullSafe(now["source"])
        inside = sized.join(now, same & (F.shiftright("hash", bits + BITS) == F.col("prefix"))).select(now["source"], "rest", F.shiftright("hash", bits).alias("b"), "size")
        sums = inside.groupBy("source", "rest", "b").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        run = sums.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
        edge = run.filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("b", "n", "upto", "rows"), "b").alias("e"))
        found = {r["source"]: r["e"] for r in edge.collect()}
        for s, x in state.items():
            if e := found.get(s):
                x |= {"prefix": e["b"], "rest": x["rest"] - (e["upto"] - e["n"]), "edge": e["rows"]}
            else:  # the budget takes all that is left (or nothing is there)
                x |= {"prefix": (x["prefix"] + 1) << BITS, "edge": 0}
        if all(x["edge"] <= 1 for x in state.values()):
            break
    return spark.createDataFrame(
        [(s, sizes[s], aim[s], x["copies"], x["prefix"] << bits, (x["prefix"] + 1) << bits, x["rest"], x["edge"]) for s, x in state.items()],
        "source string, source_size long, target double, copies long, low long, high long, rest long, edge long",
    )


def few(budget: DataFrame) -> DataFrame:
    """A budget of few enough sources to send to every task; a larger one is joined by shuffle."""
    return F.broadcast(budget) if budget.limit(BROADCAST + 1).count() <= BROADCAST else budget


def mixed(sized: DataFrame, budget: DataFrame, whole: bool = False) -> DataFrame:
    """Add source_size, target and taken to every document of measured().

    whole: the document at the threshold is taken if at least half of it fits; else the mix takes just the words that
    fit, from its start, so a source's taken words are its target to the word. Equal rows at a threshold share alike.
    """
    same = sized["source"].eqNullSafe(budget["source"])
    part = F.least(F.col("size"), F.floor(F.col("rest") / F.greatest(F.col("edge"), F.lit(1)))).cast("long")
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    more = F.when(F.col("hash") < F.col("low"), F.col("size")).when(F.col("hash") < F.col("high"), part).otherwise(0)
    return sized.join(few(budget), same).select(*[sized[c] for c in sized.columns], "source_size", "target", (F.col("copies") * F.col("size") + more).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(documents(spark, sf_dir))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Words taken of each document. Null texts and sources without words take nothing; reruns agree.

    Null sources are one source, the last. Rows equal in id and text share alike. Other columns are not read. An empty table
    gives no rows.
    """
    sized = measured(docs)
    return mixed(sized, plan(sized)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken (0, 1 or 2), whole, with its own columns.

    A document without words is kept once: it costs no budget. Columns of any name go through as they are.
    """
    sized = measured(docs)
    budget = plan(sized)
    text = F.coalesce(F.col("text"), F.lit(""))
    size, order = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)), 4)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("of"), size.alias("size"), order.alias("hash"))
    rows = rows.join(few(budget), F.col("of").eqNullSafe(F.col("source")))
    part = F.floor(F.col("rest") / F.greatest(F.col("edge"), F.lit(1)))
    more = F.when(F.col("hash") < F.col("low"), 1).when((F.col("hash") < F.col("high")) & (part * 2 >= F.col("size")), 1).otherwise(0)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies") + more).cast("int")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")
