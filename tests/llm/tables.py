"""Documents with every awkward case, and the words of the contracts in plain Python."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use for columns of their own.
        T.StructField("n_words", T.StringType()),
        T.StructField("_words", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("start", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 4999} v{i}" for i in range(12_000))
#: Two words of 1,024 to 4,096 letters that polynomial hashes modulo a power of two cannot tell apart.
TWINS = [tuple("".join(ab[bin(i).count("1") % 2] for i in range(n)) for ab in ("ab", "ba")) for n in (1024, 2048, 4096)]
PROSE = " ".join(f"alpha{i % 37} beta{i % 11} gamma{i}" for i in range(40))


def awkward():
    texts = [
        None, "", " ", "one", "One two\nOne two\n\n \nthree", PROSE, PROSE, PROSE + " more", LONG, "a" * 5000,
        "Ärger über K\u212a und ÉCOLE\tx\x0by\x85z", "the a  b   c\n  d \n", "x" + " " * 900 + "y", "日本語の文章です。" * 60,
        "# * $ % & | < > ! " * 20, "All rights reserved. CC BY, cc-by; GNU General Public License", "\x00 nul \x1c sep",
        "As As As " * 30, "all rights\nreserved " * 3, "Released under the MIT License. " + PROSE,
        "Licensed under the Apache License, Version 2.0. " * 2, "<|endoftext|> is text",
    ]
    texts += [f"{head} {x} {head} {y}" for x, y in TWINS for head in ("z", "k")]
    texts += [f"p q r {word}" for twins in TWINS for word in twins]
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else "s", "x", "y", "z", "0") for i, t in enumerate(texts)]
    # Repeated rows, a repeated id with another text, and no id at all.
    rows += [rows[5], rows[5], (5, "another text", "en", "s", "x", "y", "z", "0"), (None, PROSE, None, None, None, None, None, None)]
    rows += [(None, None, None, None, None, None, None, None)]
    return rows


def documents(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some(folder, name, columns, where="true"):
    import duckdb

    con = duckdb.connect()
    return con.execute(f"SELECT {columns} FROM '{folder}/{name}.parquet' WHERE {where}").fetchall()


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)
