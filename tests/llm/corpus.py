"""Small awkward tables for the tests of this folder."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows(texts, first=0):
    return [(first + i, t, ("en", "de", None)[i % 3], (f"src{i % 5}", None)[i % 7 == 6], None) for i, t in enumerate(texts)]


def awkward(n=40, seed=0):
    """Rows with NULLs in every column, empty, blank and long texts, ties and repeated rows."""
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "délta", "ε", "x1", "42", "token:", "σΣς", "漢字", "👩‍👧", "it's"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(n)]
    texts += [None, "", " ", "\n\t \x0b", "a" * 3000, "ab " * 4000, texts[0], texts[0] + "\n", " " + texts[0], "\x1c\x85 x", "<|endoftext|>a<|endoftext|>"]
    out = rows(texts)
    out += [out[1], out[1], (None, texts[2], None, None, None), (None, texts[2], None, None, None), (None, "only here", "en", "src1", 3), (7, None, None, None, None)]
    return out


def frame(spark, data, *extra):
    df = spark.createDataFrame(data, SCHEMA)
    for c in extra:
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df
