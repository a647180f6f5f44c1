"""Quality rules as a short-circuit cascade of column expressions.

Rules are tried on a sample for their cost and the share that they reject; the cascade tests them in order of
rejections per cost and stops at the first that rejects. The order changes the work and ``failed_rule``, never ``kept``.

Null texts have no words and fail ``short``; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.geometry import pin

from .shared import keep, words

#: Rows of the sample on which rules are timed.
SAMPLE_ROWS = 1000
RUN = 8


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


#: ``short`` and ``repeats`` are the base rules; the rest concern noise.
RULES = (
    Rule("short", lambda s: s["n_words"] < 20),
    Rule("repeats", lambda s: 100 * s["n_repeat_words"] > 30 * s["n_words"]),
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("shouting", lambda s: 10 * s["n_bangs"] > s["n_words"]),
    Rule("copied_lines", lambda s: 10 * s["n_dup_lines"] > 3 * s["n_lines"]),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"])),
)
BASE = ("short", "repeats")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(w: Column) -> Column:
    return F.when(F.size(w) > RUN, F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(w: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted beside their equals, then the length of their union."""
    spans = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: F.struct(F.array_join(F.slice(w, i + 1, RUN), " ").alias("w"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda k, o: F.coalesce(F.get(s, k)["w"] == F.get(s, k + o)["w"], F.lit(False))
        # Out of range gives null, so the first and last window have one neighbour.
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1)), lambda k: F.get(s, k)["i"]))

    def length(found: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-RUN).alias("last"))
        return F.aggregate(found, begin, lambda a, x: F.struct((a["n"] + F.least(F.lit(RUN), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return length(_let(spans, starts))


def _statistics(text: str, w: str, lines: str) -> dict[str, Column]:
    t, w, ln = F.col(text), F.col(w), F.col(lines)
    hashes = _window_hashes(w)
    # Distinct hashes prove distinct windows; only other texts have their windows compared word by word.
    repeated = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": F.when(repeated, _covered(w)).otherwise(0).cast("long"),
        "n_lines": F.size(ln).cast("long"),
        "n_bangs": F.floor((F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) / 2).cast("long"),
    }


def _split(docs: DataFrame) -> DataFrame:
    """``_row`` (the row as it is) with its text, words and lines, which filters read and do not work out again."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), t.alias("_t"))
    return pin(rows, _w=words(F.col("_t")), _l=F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second on a sample, with their cost and the share that they reject."""
    sample = keep(docs.select("text").limit(sample_rows))
    split = _split(sample)
    stats = _statistics("_t", "_w", "_l")
    rejected = split.agg(*[F.avg(F.coalesce(r.rejects(stats), F.lit(False)).cast("double")).alias(r.name) for r in rules]).first()
    found = []
    for r in rules:
        began = time.perf_counter()
        split.select(r.rejects(stats).alias("x")).write.format("noop").mode("overwrite").save()
        found.append((r, time.perf_counter() - began, rejected[r.name] or 0.0))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def _cascade(order: list[Rule], stats: Mapping[str, Column]) -> Column:
    out = None
    for r in order:
        out = out.when(r.rejects(stats), r.name) if out is not None else F.when(r.rejects(stats), r.name)
    return out


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``; later rules run only on what earlier ones leave."""
    order = [r for r, _, _ in order_rules(docs, rules)]
    split = _split(docs)
    return split.filter(_cascade(order, _statistics("_t", "_w", "_l")).isNull()).select("_row.*")


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All statistics, the base verdict, the first failed rule of the cascade and ``kept`` for every row."""
    order = [r for r, _, _ in order_rules(docs, rules)]
    split = _split(docs.select("doc_id", "text"))
    stats = split.select(F.col("_row.doc_id").alias("doc_id"), *[c.alias(n) for n, c in _statistics("_t", "_w", "_l").items()])
    by_name = {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")}
    base = [r for r in rules if r.name in BASE]
    failed = base[0].rejects(by_name)
    for r in base[1:]:
        failed = failed | r.rejects(by_name)
    return stats.withColumns({"base_failed": failed, "failed_rule": _cascade(order, by_name)}).withColumn("kept", F.col("failed_rule").isNull())
