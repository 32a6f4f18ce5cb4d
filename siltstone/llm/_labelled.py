"""Bounded samples of labelled rows, and word features, for the classifiers."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: Letters of the beginnings and endings of words that count as features.
AFFIX = range(3, 7)


def terms(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, ASCII punctuation and white space between them."""
    return (text or b"").lower().translate(_SPLIT).split()


def word_features(word: bytes) -> list[str]:
    """The word itself (``=word``), and its beginnings (``<wor``) and endings (``>ord``) shorter than it."""
    name = word.decode("utf-8", "replace")
    short = [k for k in AFFIX if k < len(name)]
    return ["=" + name, *("<" + name[:k] for k in short), *(">" + name[-k:] for k in short)]


def labelled_sample(labels: DataFrame, docs: DataFrame, rows: int, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """At most ``rows`` labelled ids (those that hash lowest) with their text as bytes and the columns ``keep``.

    ``rows`` bounds what is broadcast to find the texts.
    """
    chosen = labels.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    mine = [c for c in keep if c in labels.columns]
    theirs = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), *[c for c in keep if c not in mine])
    return theirs.join(F.broadcast(chosen.select(id_col, *mine)), id_col).select("text", *keep)


def term_table(sample: DataFrame, class_col: str) -> DataFrame:
    """(term, class_col, n): rows of each class that hold the term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = [t.decode("utf-8", "replace") for t in set(terms(text.as_py()))]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([kind] * len(found), pa.string())], ["term", class_col])

    rows = sample.select("text", F.col(class_col).cast("string").alias(class_col))
    return rows.mapInArrow(each, f"term string, {class_col} string").groupBy("term", class_col).agg(F.count("*").alias("n"))
