"""Small tables with every awkward row, and plain-Python versions of what the corpus operators compute."""

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, size string, shard int"
LONG = " ".join(f"Wort{i % 700}é" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"), (2, "the quick brown fox jumps over the lazy dog again and again"), (3, ""), (4, None), (5, " \n\t "),
    (6, "one two"), (7, "ONE two"), (8, LONG), (9, "naïve 東京 tower 🗼 of light, and more"), (None, "text of a null id"), (None, None), (12, "repeat me please now ok go"), (12, "repeat me please now ok go"),
    (-4, "negative ids come first in order of ids"), (2**40, "a far id"), (13, "control\x1cchar and\x85next line　wide"),
]
SOURCES = ["a", "b", None, "c"]


def table(spark, rows=ROWS, path=None):
    full = [(i, t, "en", SOURCES[k % 4], None if t is None else len(t), "clash", "clash", 7) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if path:
        df.write.mode("overwrite").parquet(f"{path}/documents.parquet")
        return spark.read.parquet(f"{path}/documents.parquet")
    return df


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def crc_text(x):
    return zlib.crc32(x.encode())


def plain(df):
    return [r.asDict() for r in df.collect()]
