from __future__ import annotations

import random
from collections import Counter

import pytest

from siltstone.llm import line_dedup, quality

SPACE = " \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out


def plain_figures(text):
    w = plain_words(text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    covered = {k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if plain_words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n ", "a", "x x x x x", "a b c a b c d", "é# 😀*　y\n\né# 😀*　y\nz", "w " * 400_000]
    out += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(120))) for _ in range(25)]
    out += ["\n".join(f"line {rng.randrange(6)} has several words in it {k % 3}" for k in range(30)) for _ in range(5)]
    out += [" ".join(f"word{rng.randrange(5000)}" for _ in range(200)) for _ in range(8)]
    return out


def test_figures_and_verdict_equal_brute_force(spark):
    rows = [(k, t, True) for k, t in enumerate(texts())] + [(1, "", True), (None, "null id", True)]
    got = quality.quality_cascade(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    assert len(got) == len(rows)
    by_text = {str(i): t for i, t, _ in rows}
    for r in got:
        text = by_text[str(r.doc_id)]
        figures = plain_figures(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures
        assert r.base_failed == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        d = quality.Document((text or "").encode())
        rejecting = {x.name for x in quality.RULES if x.rejects(d)} if not r.base_failed else {"base"}
        assert r.kept == (not rejecting) and (r.failed_rule in rejecting if rejecting else r.failed_rule is None)
    assert any(r.kept for r in got)
    assert quality.quality_cascade(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cascade_runs_by_rejection_per_cost():
    rules = tuple(quality.Rule(n, lambda d: False) for n in "abcd")
    figures = {"a": (1.0, 0.5), "b": (0.1, 0.2), "c": (0.5, 0.0), "d": (0.1, 0.0)}
    assert [r.name for r in quality.ordered(rules, figures)] == ["b", "a", "d", "c"]


def test_short_circuit_stops_at_the_first_rejection(spark):
    counted = spark.sparkContext.accumulator(0)

    def second(d):
        counted.add(1)
        return False

    rules = (quality.Rule("a_first", lambda d: True), quality.Rule("b_second", second))
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(60))) for k in range(40)], "doc_id long, text string")
    got = quality.quality_cascade(docs, rules, sample_rows=4).collect()
    assert {r.failed_rule for r in got} == {"a_first"} and counted.value == 4  # on the sample only


def plain_lines(rows, ratio, least, keep_first):
    pages, total = {}, Counter()
    for i, text, site in rows:
        total[site or ""] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None else ():
            pages.setdefault((site or "", line), []).append(i)
    often = {k: min(v) for k, v in pages.items() if len(v) >= least and len(v) > ratio * total[k[0]]}
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        rest = [x for x in lines if (site or "", x.strip(" ")) not in often or keep_first and often[site or "", x.strip(" ")] == i]
        out.append((i, "\n".join(rest), len(lines), len(lines) - len(rest)))
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("limit", [100_000, -1])
def test_lines_equal_brute_force(spark, monkeypatch, keep_first, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rng = random.Random(4)
    rows = []
    for k in range(120):
        lines = [rng.choice(["menu", " menu ", "footer", "rare", "", "  ", f"own {k}", f"own {k} more"]) for _ in range(rng.randrange(9))]
        rows.append((k, "\n".join(lines), rng.choice(["hot", "hot", "a", None])))
    rows += [(900, None, "a"), (901, "", None), (902, "menu\n" * 5000, "hot")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, n_lines int, line string")
    got = line_dedup.dedup_lines(docs, ratio=0.1, min_pages=4, keep_first=keep_first)
    assert got.columns == ["doc_id", "text", "source", "line", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == sorted(plain_lines(rows, 0.1, 4, keep_first))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(docs.unionByName(docs), ratio=0.1, min_pages=4)
    assert twice.count() == 2 * len(rows)
