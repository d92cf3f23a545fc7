"""Quality rules: a table of thresholds compiled into one Spark projection. No user function runs.

Words are runs of characters outside [\\x20\\x09-\\x0D]. Per text: n_words, word_chars, n_symbols, n_dup_lines and
n_repeat_words (words inside 3-word windows that occur twice or more in the text). Windows are compared by 64-bit hash
and sorted, so the cost is n log n for any text length.

Defined cases: null and empty texts have no words and fail; one-line texts have no duplicate lines; other columns pass
through whatever their names; an empty table gives an empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "in", "to", "a", "is", "that", "it", "for", "was", "with", "on", "as", "by", "this", "be", "at", "an", "or", "are", "not", "what",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "dans", "que", "qui", "pour", "au", "sur", "par", "avec", "ce", "pas",
    "der", "die", "das", "und", "ein", "eine", "den", "dem", "ist", "zu", "mit", "von", "sich", "auf", "nicht", "im", "für", "auch",
    "el", "los", "las", "y", "en", "se", "del", "una", "con", "por", "su", "para", "es", "al", "no",
]

#: The threshold table: (rule, numerator, denominator, least, most). A text is kept if every ratio lies within its limits.
RULES: list[tuple[str, str, str | None, float | None, float | None]] = [
    ("enough words", "n_words", None, 50, None),
    ("repeated windows", "n_repeat_words", "n_words", None, 0.5),
    ("word length", "word_chars", "n_words", 2.0, 14.0),
    ("symbols a word", "n_symbols", "n_words", None, 0.2),
    ("stop words", "n_stop_words", "n_words", 0.05, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 0.6),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice."""

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(placed, lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        starts = F.array_sort(F.transform(twins, lambda e: e["i"]))
        first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(starts, first, step, lambda a: a["n"])

    def of(w: Column) -> Column:
        windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))

    return let(words, of)


def measures(text: Column) -> dict[str, Column]:
    """The counts that rules refer to, as expressions over `words`, `lines` and the text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {"words": words, "lines": lines, "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint")}


def compile_rules(rules: list[tuple[str, str, str | None, float | None, float | None]]) -> Column:
    """One boolean expression for the whole table; ratios are compared as products, so nothing is divided by zero."""
    kept = F.lit(True)
    for _, top, bottom, least, most in rules:
        base = F.col(f"_q.{bottom}") if bottom else F.lit(1)
        if least is not None:
            kept = kept & (F.col(f"_q.{top}") >= F.lit(least) * base)
        if most is not None:
            kept = kept & (F.col(f"_q.{top}") <= F.lit(most) * base)
    return kept


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with one more column, the struct `_q` of all counts (a column of docs with that name is replaced)."""
    m = measures(F.col(f"`{text_col}`"))
    stop = F.filter("_q.words", lambda w: F.lower(w).isin(STOP_WORDS))
    first = docs.withColumn("_q", F.struct(m["words"].alias("words"), m["lines"].alias("lines"), m["n_symbols"].alias("n_symbols")))
    counts = {
        "n_words": F.size("_q.words"),
        "word_chars": F.length(F.array_join("_q.words", "")),
        "n_symbols": F.col("_q.n_symbols"),
        "n_lines": F.size("_q.lines"),
        "n_dup_lines": F.size("_q.lines") - F.size(F.array_distinct("_q.lines")),
        "n_repeat_words": repeated_words(F.col("_q.words")),
        "n_stop_words": F.size(stop),
    }
    return first.withColumn("_q", F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()]))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """Per document its counts, base_failed and kept."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    q = measured(narrow).withColumn("_v", compile_rules(rules or RULES))
    base = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return q.select("doc_id", *[F.col(f"_q.{n}").alias(n) for n in names], base.alias("base_failed"), (~base & F.col("_v")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """The rows of docs that pass every rule, with all their columns."""
    source = docs.select(F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return measured(source).where(compile_rules(rules or RULES)).select("_row.*")


def _sql_rule(rule: tuple[str, str, str | None, float | None, float | None]) -> list[str]:
    _, top, bottom, least, most = rule
    base = bottom or "1"
    return ([f"{top} >= CAST({least} AS DOUBLE) * {base}"] if least is not None else []) + ([f"{top} <= CAST({most} AS DOUBLE) * {base}"] if most is not None else [])


def oracle(source: str = "documents", columns: str = "") -> str:
    """DuckDB SQL for quality_report over a table."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(x for r in RULES for x in _sql_rule(r))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {source}
), pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3
), win AS (
  SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {rules} AS kept
FROM m"""
