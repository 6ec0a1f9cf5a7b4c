"""Operator 2: quality rules as a short-circuit cascade, in DataFrame functions only.

`measures` adds the counts that rules are written in; `cascade` estimates on a
bounded sample what each rule costs and how often it rejects, and orders the
rules by rejections per cost, so that most bad documents leave at the first,
cheap rules. The verdict is the same in any order.

Equal 5-word windows are found by 64-bit hashes within one document only.

Nulls and ties: a null text is an empty text, with zero counts; rows stand for
themselves, whatever their ids; an empty table gives no rows and keeps the
rules in the order given.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sealed, table

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """`rejects` is true for documents that the rule turns away."""

    name: str
    rejects: Column


def counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_lines and n_dup_lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({"_words": F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    return docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")


def repeats(docs: DataFrame) -> DataFrame:
    """`docs`, as `counts` leaves it, with n_repeat_words: words in 5-word windows found twice or more."""
    docs = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.slice("_h", 1, F.greatest(F.size("_h") - (WINDOW - 1), F.lit(0)))
    docs = docs.withColumn("_g", F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get("_h", i + k) for k in range(1, WINDOW)))))
    # Only the few texts that repeat a window are sorted.
    paired = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    docs = docs.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), paired))
    again = F.filter("_s", lambda p, j: (F.get("_s", j - 1)["g"] == p["g"]) | (F.get("_s", j + 1)["g"] == p["g"]))
    docs = docs.withColumn("_at", F.sort_array(F.transform(again, lambda p: p["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_h", "_g", "_s", "_at", "_words")


def measures(docs: DataFrame) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    return sealed(repeats(counts(docs)), {n: F.col(n) for n in names})


def base_rules() -> list[Rule]:
    return [Rule("few_words", F.col("n_words") < 10), Rule("repeated_words", 100 * F.col("n_repeat_words") > 20 * F.col("n_words"))]


def text_rules() -> list[Rule]:
    """Rules that reject junk and leave prose of any language alone."""
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace("text", r"\P{Lu}+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("capitals", 2 * capitals > letters),
        Rule("marks", 4 * F.length(F.regexp_replace("text", r"[^!?]+", "")) > F.col("n_words") * 4),
    ]


def order(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, sample_bytes: int = 100_000, repeat: int = 4) -> list[Rule]:
    """`rules` by rejections per second on a sample of `sample_rows` rows with texts of up to `sample_bytes`, each judged
    `repeat` times; equal ones, cheapest first. The time that any query over the sample takes is left out, and so is the
    first run, which compiles. Only the order of work follows from it, so the sample may be any rows."""
    sample = docs.filter(F.octet_length("text") <= sample_bytes).limit(sample_rows).persist()
    rows = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def judged(rejects: Column) -> tuple[float, int]:
        seconds, rejected = [], 0
        for _ in range(2):
            began = time.perf_counter()
            rejected = rows.agg(F.sum(F.coalesce(rejects, F.lit(False)).cast("int"))).first()[0] or 0
            seconds.append(time.perf_counter() - began)
        return seconds[-1], rejected

    try:
        sample.count()
        idle, _ = judged(F.length("text") < 0)
        worth = []
        for i, rule in enumerate(rules):
            seconds, rejected = judged(rule.rejects)
            cost = max(seconds - idle, 1e-4)
            worth.append((-rejected / cost, cost, i))
    finally:
        sample.unpersist()
    return [rules[i] for *_, i in sorted(worth)]


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with `failed`, the first rule that rejects a row, or null."""
    failed = F.lit(None).cast("string")
    for rule in reversed(rules):
        failed = F.when(rule.rejects, F.lit(rule.name)).otherwise(failed)
    return docs.withColumn("failed", failed)


def quality(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """`docs` with the measures, base_failed, failed and kept."""
    measured = measures(docs)
    rules = order(measured, text_rules()) if rules is None else rules
    base = base_rules()
    base_failed = base[0].rejects | base[1].rejects
    return cascade(measured, base + rules).withColumns({"base_failed": base_failed, "kept": F.col("failed").isNull()})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS o(k) GROUP BY doc_id),
m AS (SELECT doc_id, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals,
        length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 2 * letters < word_chars OR 2 * capitals > letters OR 4 * marks > 4 * n_words) AS kept
FROM f
"""
