"""Small tables, and the whole small documents table."""

import re

import pandas as pd

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four"), (6, "a\x0bb\x0cc\rd"), (7, "x" * 5000), (8, "é½Ⅷ中 \U0001f600 's 're ''s  !! 　 z"),
    (9, "the same text twice over and over again now"), (10, "the same text twice over and over again now"), (10, "the same text twice over and over again now"),
    (11, "word " * 30000), (None, "no id here at all but words"), (12, "1234 5678"), (13, "<b>&amp;|%$#*</b>\n\n\nline\nline\nline"),
]


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def wide(spark, rows=ODD):
    """Extra columns whose names clash with what operators use inside."""
    return frame(spark, rows).selectExpr("doc_id", "text", "1 as id", "'x' as lang", "2 as n", "3 as key", "4 as line", "5 as size", "6 as a", "7 as b", "8 as n_chars", "9 as component", "10 as _part")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
