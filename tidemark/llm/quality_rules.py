"""Quality rules: a table of thresholds compiled into one Spark projection.

Counts and ratios of a text's length, symbols, stop words and lines are built-in expressions; each
row of ``RULES`` becomes a comparison of two counts in whole numbers. No user function runs.

Edge cases: a null text has no words, lines or symbols; a null or empty text fails the base rule;
texts are read whole; repeated rows are judged each; an empty table gives an empty result; columns
of ``docs`` whose names the result needs are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the controls 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Stripped from a word before it is looked up among the stop words.
MARKS = ".,;:!?\"'()"
WINDOW = 5

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at this from or an not have "
    "der die das und ist ein eine in den von zu mit auf für im nicht des sie es "
    "le la les de des du et un une en est que qui dans pour sur avec par pas au "
    "el los las y del se por con para una su al lo como más o a"
).split()

#: (name, count, times, other count, limit, least words): the rule fails a text of at least that many
#: words if times * count > limit * other count.
RULES: list[tuple[str, str, int, str, int, int]] = [
    ("long_words", "word_chars", 1, "n_words", 20, 0),
    ("symbols", "n_symbols", 10, "n_words", 1, 0),
    ("exclamations", "n_exclamations", 2, "n_words", 1, 0),
    ("repeated_lines", "n_dup_lines", 10, "n_lines", 3, 0),
    ("few_stop_words", "n_words", 1, "n_stop_words", 100, 100),
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in a window that is found twice or more in the same text."""

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
            found = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["total"] + F.least(F.lit(window), p - acc["last"])).alias("total"))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(F.aggregate(_let(ordered, places), start, step)["total"])

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.array_join(F.slice(w, i, window), " "))
        return F.when(F.size(w) <= window, 0).otherwise(_let(windows, covered))

    return counted(words)


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: _without(line, SPACES) != "")
    count = lambda characters: (F.length(text) - F.length(_without(text, characters))).cast("long")
    stops = lambda w: F.size(F.filter(w, lambda x: _without(F.lower(x), MARKS).isin(STOP_WORDS))).cast("long")
    of_words = _let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"), stops(w).alias("n_stop_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"), F.length(_without(text, SPACES)).cast("long").alias("word_chars"), count(SYMBOLS).alias("n_symbols"), count("!").alias("n_exclamations"))


def judge(docs: DataFrame, *, rules: list[tuple] = RULES, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """The columns of ``docs`` other than text, all counts, base_failed, failed_rules and kept."""
    made = ["n_words", "n_repeat_words", "n_stop_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_exclamations"]
    rest = [c for c in docs.columns if c not in {*made, "text", "base_failed", "failed_rules", "kept", "_m"}]
    counted = docs.select(*(F.col(c) for c in rest), measures(F.col("text")).alias("_m")).select(*rest, "_m.w.*", "_m.l.*", "_m.word_chars", "_m.n_symbols", "_m.n_exclamations")
    failed = [F.when((F.col("n_words") >= least) & (times * F.col(count) > limit * F.col(other)), F.lit(name)) for name, count, times, other, limit, least in rules]
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    judged = counted.select("*", base.alias("base_failed"), F.array_compact(F.array(*failed)).alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(rules: list[tuple] = RULES) -> str:
    """The result of the registered query as SQL for DuckDB."""
    spaces = " || ".join(f"chr({ord(c)})" for c in SPACES)
    blank = f"translate(text, {spaces}, '{' ' * len(SPACES)}')"
    verdict = " AND ".join(f"NOT (n_words >= {least} AND {times} * {count} > {limit} * {other})" for _, count, times, other, limit, least in rules)
    marks = " || ".join(f"chr({ord(c)})" for c in MARKS)
    stops = ", ".join(_quoted(w) for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(string_split({blank}, ' '), lambda x: x <> '') AS words FROM d),
g AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS p, words FROM w WHERE len(words) > {WINDOW}),
h AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(words[p:p + {WINDOW - 1}], ' ')) AS times FROM g),
c AS (SELECT r, least({WINDOW}, p - coalesce(lag(p) OVER (PARTITION BY r ORDER BY p), -{WINDOW})) AS fresh FROM h WHERE times > 1),
n AS (SELECT r, sum(fresh) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS lines FROM d),
m AS (SELECT doc_id, len(words) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: list_contains([{stops}], translate(lower(x), {marks}, '')))) AS n_stop_words,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(translate(text, {spaces}, '')) AS word_chars,
    length(text) - length(translate(text, {_quoted(SYMBOLS)}, '')) AS n_symbols, length(text) - length(translate(text, '!', '')) AS n_exclamations
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept
FROM b"""
