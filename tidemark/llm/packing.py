"""First-fit decreasing packing with a tournament tree, in randomised groups of documents.

Texts are encoded once; each document is cut into pieces of at most 2048 ids, all but the last of full length. Pieces
are dealt at random into groups of about 8192, and each group is packed by itself: longest pieces first, each into the
first sequence with room. A tournament tree over the room of all sequences finds that sequence in log time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import crc, documents, encoder, lean, small_batches, stored
from tidemark.llm.tokens import default_tokenizer

LENGTH, END, GROUP = 2048, 1, 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """Every document's ids (and end_id) cut into pieces of at most `length`. Null and empty texts are end_id alone.
    with_ids adds the ids of each piece."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows: dict[str, list] = {n: [] for n in [*names, *["ids"] * with_ids]}
            docs, row = b.column(0).to_pylist(), 0
            for n, ids, ends in enc.batches(b.column(1)):
                flat = np.insert(ids, ends, end_id).astype("<u4", copy=False)  # behind each document's ids
                first = 0
                for doc, last in zip(docs[row : row + n], (ends + np.arange(1, n + 1)).tolist(), strict=True):
                    for at in range(first, last, length):
                        part = flat[at : min(at + length, last)]
                        for c, v in zip(names, (doc, at - first, len(part), crc(part), last - first), strict=True):
                            rows[c].append(v)
                        if with_ids:
                            rows["ids"].append(part.astype(np.int32))
                    first = last
                row += n
            out = {n: pa.array(rows[n], pa.int64()) for n in names}
            if with_ids:
                out["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECES + ", ids array<int>" * with_ids)


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the given order: the first bin with enough room, found from the root of a tree
    whose nodes hold the largest room below them."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        if size > room:
            raise ValueError(f"a piece of {size} does not fit into {room}")
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins.append(at - leaves)
        offsets.append(room - tree[at])
        tree[at] -= size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return bins, offsets


def pack(items: DataFrame, room: int = LENGTH, group_rows: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a `length` of at most room. items must come from files.

    Groups are drawn by a hash that includes the row's place in its file, so that repeated rows spread too.
    sequence_id is group * 2**32 + the sequence's number in its group.
    """
    groups = max(1, -(-items.count() // group_rows))
    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit("pack")), F.lit(groups)).cast("long"))
    out = f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes)}, sequence_id long, offset long"
    order = [c for c in ("length", "doc_id", "start") if c in items.columns]

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[False] + [True] * (len(order) - 1), kind="stable")
        bins, offsets = first_fit(pdf["length"].tolist(), room)
        pdf["sequence_id"] = (int(pdf["_group"].iloc[0]) << 32) + np.asarray(bins, np.int64)
        pdf["offset"] = np.asarray(offsets, np.int64)
        return pdf.drop(columns="_group")

    return dealt.groupBy("_group").applyInPandas(each, out)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; odd rows as in pack_documents(). Texts of any length are cut into pieces."""
    return pack_documents(documents(spark, sf_dir), default_tokenizer())


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of every document with their sequence and place there. Documents of null id or text, empty ones and
    repeated rows are packed like others; other columns are not read. An empty table gives no rows."""
    return pack(stored(pieces(docs, tokenizer)))
