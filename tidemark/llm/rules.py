"""Quality rules (DataFrame functions only): a threshold table compiled into one projection.

Measures of a text (lengths, symbols, stop words, lines, repeated windows) are one expression, bound once with ``let``; every
row of the threshold table becomes a comparison of whole numbers over them.  Nothing is joined, aggregated or shuffled, so a
text costs the same wherever it lies, and hot sources or copies cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = "\t\n\v\f\r "
SYMBOLS = "#*$%&|<>"
#: A whole word without a letter; possessive, so that a long one is read once.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"
#: A stop word may carry one of these at its end.
PUNCTUATION = ".,;:!?"

# Frequent function words of each language, ASCII only.
STOP_WORDS = {
    "en": "the be to of and a in that have it for not on with as do at this but by from or is was are".split(),
    "de": "der die das und in den von zu mit sich des ein auf ist im dem nicht als auch es an er so dass".split(),
    "fr": "le la les de des du et en un une que est pour qui dans par sur au pas plus ce il elle ne se".split(),
    "es": "el la los las de del y en un una que se por con no para su al es lo como o sus le".split(),
}


@dataclass(frozen=True)
class Threshold:
    """A text fails ``rule`` unless ``low <= measure <= high``; with ``per``, bounds are hundredths of that other measure.

    With ``lang`` the row holds for texts of that language only.
    """

    rule: str
    measure: str
    low: int | None = None
    high: int | None = None
    per: str | None = None
    lang: str | None = None

    def broken(self, measures: Column, lang: Column) -> Column:
        value, unit = (measures[self.measure] * 100, measures[self.per]) if self.per else (measures[self.measure], F.lit(1))
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (value < unit * self.low)
        if self.high is not None:
            bad = bad | (value > unit * self.high)
        return bad if self.lang is None else F.coalesce(lang == self.lang, F.lit(False)) & bad


#: Rows that the query reports as ``base_failed``.
BASE = [
    Threshold("few_words", "n_words", low=50),
    Threshold("repeated_words", "n_repeat_words", high=50, per="n_words"),
]
#: The other rows of the table.
TABLE = [
    Threshold("many_words", "n_words", high=1_000_000),
    Threshold("short_words", "word_chars", low=250, per="n_words"),
    Threshold("long_words", "word_chars", high=1500, per="n_words"),
    Threshold("symbols", "n_symbols", high=10, per="n_words"),
    Threshold("words_without_letters", "n_letter_words", low=70, per="n_words"),
    Threshold("repeated_lines", "n_dup_lines", high=50, per="n_lines"),
    Threshold("bullets", "n_bullet_lines", high=90, per="n_lines"),
    Threshold("ellipses", "n_ellipsis_lines", high=30, per="n_lines"),
    *[Threshold(f"stop_words_{lang}", "n_stop_words", low=6, per="n_words", lang=lang) for lang in STOP_WORDS],
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _count(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def stop_forms(lang: str) -> list[str]:
    """The stop words of a language in lower case, capitalised and in capitals, bare or with a mark at the end."""
    return [form + mark for w in STOP_WORDS[lang] for form in dict.fromkeys((w, w.capitalize(), w.upper())) for mark in ("", *PUNCTUATION)]


def repeated_window_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in ``words``, first occurrences included.

    Windows are compared by 64-bit hashes.  A text whose windows are all distinct (found with a hash set) is done; else they
    are sorted with their places, equal ones are neighbours, and the places of repeated windows, in order, cover ``width``
    words each less what the window before has covered.
    """

    def covered(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        starts = F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(starts, start, step)["n"]

    def of(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.sort_array(placed), covered)).otherwise(0)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))
    return F.when(F.size(words) > width, let(hashes, of)).otherwise(0).cast("long")


def measures(text: Column, lang: Column) -> Column:
    """A struct of whole numbers about a whole text; null counts as the empty text, whose measures are all 0.

    Stop words are those of the text's language; other languages have none.
    """
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        stops = F.lit(0).cast("long")
        for known in STOP_WORDS:
            stops = F.when(lang == known, F.size(F.filter(words, lambda w: w.isin(stop_forms(known)))).cast("long")).otherwise(stops)  # noqa: B023  (called at once)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_window_words(words).alias("n_repeat_words"),
            stops.alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _count(lines, lambda x: F.substring(F.ltrim(x, F.lit(BLANKS)), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
            _count(lines, lambda x: let(F.rtrim(x, F.lit(BLANKS)), lambda y: y.endswith("...") | y.endswith("…"))).alias("n_ellipsis_lines"),
        )

    words = let(F.filter(F.split(text, SPACE), lambda w: w != ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    matches = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    both = lambda w, x: F.struct(
        *[w[c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")],
        *[x[c].alias(c) for c in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")],
        matches(f"[{SYMBOLS}]").alias("n_symbols"),
        (w["n_words"] - matches(LETTERLESS)).alias("n_letter_words"),
    )
    return let(words, lambda w: let(lines, lambda x: both(w, x)))


def failed_rules(of: Column, lang: Column, rows: Sequence[Threshold]) -> Column:
    """Names of the table's rows that a text with the measures ``of`` breaks, in the table's order."""
    return F.filter(F.array(*[F.when(t.broken(of, lang), F.lit(t.rule)) for t in rows]), lambda x: x.isNotNull())


def judge(df: DataFrame, text: str = "text", lang: str = "lang", rows: Sequence[Threshold] = (*BASE, *TABLE), out: str = "rules") -> DataFrame:
    """``df`` with a struct ``out`` = (measures, failed, kept): kept where no row of the table is broken.

    Null and empty texts have measures of 0; a null or unlisted language breaks no row of a language.  Every row is judged
    by itself: repeated rows get equal answers, an empty table gives an empty one.  Other columns stay; a column called
    ``out`` is refused.
    """
    if out in df.columns:
        raise ValueError(f"column already present: {out}")
    if not rows:
        raise ValueError("the threshold table has no rows")
    told = let(measures(F.col(text), F.col(lang)), lambda m: let(failed_rules(m, F.col(lang), rows), lambda f: F.struct(m.alias("measures"), f.alias("failed"), (F.size(f) == 0).alias("kept"))))
    return df.withColumn(out, told)


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = F.exists("rules.failed", lambda x: x.isin([t.rule for t in BASE]))
    return judged.select("doc_id", *[F.col(f"rules.measures.{c}").alias(c) for c in shown], base.alias("base_failed"), F.col("rules.kept").alias("kept"))


def _stop_sql() -> str:
    names = lambda lang: ", ".join(f"'{w}'" for w in stop_forms(lang))
    return " OR ".join(f"(lang = '{lang}' AND 100 * len(list_filter(words, lambda x: x IN ({names(lang)}))) < 6 * n_words)" for lang in STOP_WORDS)


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), m AS (
  SELECT r, doc_id, lang, words, lines, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w
), starts AS (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM m
), counted AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS k FROM starts
), covered AS (
  SELECT r, count(DISTINCT i + j) AS n FROM counted, (VALUES (0), (1), (2)) AS v(j) WHERE k > 1 GROUP BY r
), x AS (
  SELECT m.*, coalesce(n, 0) AS n_repeat_words FROM m LEFT JOIN covered USING (r)
), y AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_words > 1000000 OR 100 * word_chars < 250 * n_words OR 100 * word_chars > 1500 * n_words
    OR 100 * n_symbols > 10 * n_words OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) < 70 * n_words
    OR 100 * n_dup_lines > 50 * len(lines) OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 90 * len(lines)
    OR 100 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 30 * len(lines)
    OR coalesce({_stop_sql()}, false)) AS kept
FROM y
"""
