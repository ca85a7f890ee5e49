"""Statistics of whole texts as Spark column expressions, without any Python.

All of them are evaluated row by row inside the scan's stage: nothing is exploded
into word rows and nothing is shuffled. Null counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import WORD, WORD_BREAKS, fresh, quoted

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
#: Words of a window that counts as a repeated passage.
WINDOW = 8


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def windows(hashes: Column, span: int) -> Column:
    """Hashes of ``2 * span`` neighbours from those of ``span``."""
    n = F.greatest(F.size(hashes) - span, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, span + 1, n), lambda a, b: F.xxhash64(a, b))


def with_windows(df: DataFrame, words_col: str, out: str, size: int = WINDOW) -> DataFrame:
    """``df`` with one 64-bit hash per window of ``size`` words; ``size`` is a power of two.

    Hashes of pairs, of pairs of pairs and so on, each a column of its own: nested
    in one expression they would be computed once per mention.
    """
    df = df.withColumn(out, F.transform(F.col(words_col), lambda x: F.xxhash64(x)))
    span = 1
    while span < size:
        df = df.withColumn(out, windows(F.col(out), span))
        span *= 2
    return df


def covered(hashes: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows whose hash occurs twice or more.

    Windows sorted by hash lie beside their equals; the starts of those, sorted,
    cover up to ``size`` words each, less the overlap with the next start.
    """
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(x: Column, i: Column, all_: Column) -> Column:
        before = F.coalesce(F.get(all_, i - 1)["h"] == x["h"], F.lit(False))
        return before | F.coalesce(F.get(all_, i + 1)["h"] == x["h"], F.lit(False))

    def starts(sorted_: Column) -> Column:
        return F.array_sort(F.transform(F.filter(sorted_, lambda x, i: twice(x, i, sorted_)), lambda x: x["i"]))

    def total(s: Column) -> Column:
        steps = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    # let x = expr in f(x), as a one-element transform: each array is made once
    once = lambda value, f: F.transform(F.array(value), f)[0]
    return once(placed, lambda p: once(starts(p), total))


def with_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper and n_marks (long).

    Columns of those names are replaced.
    """
    names = STATS
    t, w, h, ln = (fresh(df, x) for x in ("t", "w", "h", "l"))
    rest = [quoted(c) for c in df.columns if c.lower() not in names]
    text = F.coalesce(quoted(text_col), F.lit(""))
    one = df.withColumn(t, text).withColumn(w, words(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, WORD_BREAKS, "") != "")
    two = with_windows(one, w, h).withColumn(ln, lines)
    repeats = F.when(F.size(F.array_distinct(F.col(h))) == F.size(F.col(h)), F.lit(0)).otherwise(covered(F.col(h)))
    return two.select(
        *rest,
        F.size(F.col(w)).cast("long").alias("n_words"),
        F.length(F.translate(F.col(t), WORD_BREAKS, "")).cast("long").alias("word_chars"),
        (F.length(F.col(t)) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(F.col(ln)) - F.size(F.array_distinct(F.col(ln)))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(F.col(t), r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        (F.length(F.col(t)) - F.length(F.translate(F.col(t), MARKS, ""))).cast("long").alias("n_marks"),
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
