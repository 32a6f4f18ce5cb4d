"""Quality rules as a short-circuit cascade.

Each rule looks at a document and says whether it rejects it.  The cost of a
rule and the share of documents it rejects are measured on a bounded sample;
the cascade then runs rules by falling rejection per cost and stops at the
first that rejects.  The verdict does not depend on the order, only the time
spent does.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._runtime import few

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Documents on which rules are measured, at most.
SAMPLE_ROWS = 256


class Document:
    """A text and what rules ask of it, each computed once and only when asked for."""

    def __init__(self, text: bytes | None):
        self.raw = text or b""

    @cached_property
    def text(self) -> str:
        return self.raw.decode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        """Maximal runs of bytes other than space and 0x09-0x0D."""
        return self.raw.split()

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def codes(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        seen: dict[bytes, int] = {}
        return np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), dtype=np.int64, count=self.n_words)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that stand in a window of three words that occurs twice or more."""
        c = self.codes
        if len(c) < 4:
            return 0
        base = int(c.max()) + 1
        if base < 1 << 20:
            windows = (c[:-2] * base + c[1:-1]) * base + c[2:]
        else:
            pairs = np.unique(c[:-1] * base + c[1:], return_inverse=True)[1]
            windows = pairs[:-1] * base + c[2:]
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        same = ordered[1:] == ordered[:-1]
        often = np.zeros(len(windows), dtype=bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        covered = np.zeros(len(c), dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(windows)] |= often
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Document], bool]


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_BULLETS = (b"-", b"*", "•".encode(), "‣".encode())

#: The production rules.  Limits are shares or means, so they hold for any length and language with spaces.
RULES = (
    Rule("mean_word_length", lambda d: not 2 <= _share(d.word_chars, d.n_words) <= 20),
    Rule("symbols", lambda d: d.n_symbols > 0.1 * d.n_words),
    Rule("duplicate_lines", lambda d: d.n_dup_lines > 0.3 * len(d.lines)),
    Rule("ellipsis_lines", lambda d: sum(x.rstrip().endswith((b"...", "…".encode())) for x in d.lines) > 0.3 * len(d.lines)),
    Rule("bullet_lines", lambda d: sum(x.lstrip().startswith(_BULLETS) for x in d.lines) > 0.9 * len(d.lines)),
    Rule("words_without_letters", lambda d: sum(1 for w in d.words if not _LETTER.search(w)) > 0.4 * d.n_words),
    Rule("few_distinct_words", lambda d: d.n_words >= 100 and int(d.codes.max()) + 1 < 0.05 * d.n_words and int(d.codes.max()) + 1 < 50),
)


#: The base figures of a document, in the order of the result's columns.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(d: Document) -> bool:
    return d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words


def measure(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, sample_rows: int) -> dict[str, tuple[float, float]]:
    """Rule name to (seconds a document, share rejected) on the ``sample_rows`` documents whose ids hash lowest.

    The base figures are computed first, as they are for every document, so a
    cost is what the rule adds to them.  Of a repeated id one row is measured;
    rows without an id are not.
    """
    ids = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_rows).collect()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for x in batch.column(0):
                d, rows = Document(x.as_py()), rows + 1
                for c in COUNTS:
                    getattr(d, c)
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += bool(rule.rejects(d))
                    spent[k] += time.perf_counter() - began
        if rows:
            n = len(rules)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(spent), pa.array(hits, pa.int64()), pa.array([rows] * n, pa.int64())], ["rule", "spent", "hits", "seen"])

    if not ids:
        return {r.name: (1.0, 0.0) for r in rules}
    sample = docs.where(F.col(id_col).isin(ids)).dropDuplicates([id_col]).select(F.col(text_col).cast("binary"))
    found = sample.mapInArrow(each, "rule int, spent double, hits long, seen long").groupBy("rule").agg(F.sum("spent"), F.sum("hits"), F.sum("seen")).collect()
    return {rules[r[0]].name: (r[1] / r[3], r[2] / r[3]) for r in found}


def ordered(rules: tuple[Rule, ...], figures: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """By falling rejection per cost; ties by name."""
    return tuple(sorted(rules, key=lambda r: (-_share(figures[r.name][1], max(figures[r.name][0], 1e-9)), figures[r.name][0], r.name)))


def quality_cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row per row of ``docs``: id, the base figures, base_failed, kept and failed_rule.

    ``failed_rule``: 'base', or the first rule of the cascade that rejects,
    else null; rules of like cost may change places from run to run, which
    changes this column alone.  A null text has no words and fails the base.  Repeated rows
    give one row each; null ids are kept as they are; an empty table gives
    none; other columns are not read.  The base figures are computed for all
    documents, the rules only until one rejects.
    """
    cascade = ordered(rules, measure(docs, rules, id_col, text_col, sample_rows))
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            rows = []
            for x in batch.column(1):
                d = Document(x.as_py())
                failed = "base" if base_failed(d) else next((r.name for r in cascade if r.rejects(d)), None)
                rows.append((*(getattr(d, c) for c in COUNTS), failed == "base", failed is None, failed))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["id", *COUNTS, "base_failed", "kept", "failed_rule"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, failed_rule string"
    return rows.mapInArrow(each, schema).withColumnRenamed("id", id_col)
