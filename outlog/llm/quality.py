"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over per-document measures plus the measures it needs.  A bounded
sample gives each rule's rejection rate and the mean work of its measures; rules then run in
the order of rejection per cost as one nested CASE, whose later branches are not evaluated for
rows that an earlier rule rejects.  The order never changes the verdict, only the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2000  # rows read to estimate costs and rejection rates (order only, never verdicts)


@dataclass(frozen=True)
class Rule:
    """``fails`` is evaluated on the measured columns; ``work`` estimates its cost on a row."""

    name: str
    fails: Column
    work: Column


def _removed(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(words_col: str, out: str, df: DataFrame, width: int = WINDOW) -> DataFrame:
    """Add ``out``: words inside ``width``-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash.  Texts without a repeated window (most) stop after
    a hash-set pass; the others sort (hash, start) once and count the covered words, so the
    work is n log n in the words of a text, not quadratic.
    """
    ws = F.col(words_col)
    starts = F.sequence(F.lit(0), F.size(ws) - width)
    hashes = F.when(F.size(ws) >= width, F.transform(
        starts, lambda i: F.xxhash64(*[F.get(ws, (i + k).cast("int")) for k in range(width)])))
    df = df.withColumn("_h", F.coalesce(hashes, F.array().cast("array<bigint>")))
    has = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_p", F.when(has, F.sort_array(F.transform(
        F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    same = lambda a, b: F.get(p, a)["h"] == F.get(p, b)["h"]
    hit = F.transform(p, lambda x, j: F.when(
        F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), x["i"]))
    df = df.withColumn("_s", F.when(F.col("_p").isNotNull(),
                                    F.sort_array(F.filter(hit, lambda x: x.isNotNull()))))
    s = F.col("_s")
    # a start covers its window up to the next start; the last one covers all of it
    gaps = F.transform(s, lambda x, j: F.least(F.coalesce(F.get(s, j + 1) - x, F.lit(width)), F.lit(width)))
    n = F.when(s.isNull(), F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x))
    return df.withColumn(out, n.cast("long")).drop("_h", "_p", "_s")


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the measures of every whole text (null or blank: all zero).

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal
    to an earlier line), n_lines (lines with a word), n_nondigits (characters of words that are no ASCII digits) and
    n_repeat_words (see ``repeat_words``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_w", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SEPARATORS, "")) > 0)
    df = df.withColumn("_l", lines)
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": _removed(text, SEPARATORS).cast("long"),
        "n_symbols": (F.length(text) - _removed(text, SYMBOLS)).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_nondigits": _removed(text, "0123456789" + SEPARATORS).cast("long"),
    })
    return repeat_words("_w", "n_repeat_words", df).drop("_w", "_l")


def default_rules() -> list[Rule]:
    """Production thresholds: junk is far outside them, ordinary prose of any language inside."""
    w, c = F.col("n_words"), F.col("word_chars")
    line_work, char_work, window_work = F.col("n_lines") * 20, c, w * 40
    return [
        Rule("too_short", w < 10, w),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * w, window_work),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * w, char_work),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"), line_work),
        Rule("word_length", (c < 2 * w) | (c > 15 * w), char_work),
        Rule("digits", 2 * F.col("n_nondigits") < c, char_work),
    ]


def order_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, mean cost) by rejection per cost, highest first; ties by name.

    Estimated on the rows with the ``sample_rows`` smallest id hashes (the same on every run):
    a top-k over the ids alone finds the largest of these hashes, then only the rows up to it
    are measured.  On an empty table every estimate is zero and the order is by name.
    """
    h = F.xxhash64(F.col(id_col))
    last = docs.select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    measured, aggs = measure(docs.where(h <= F.lit(last).cast("long")).select(id_col, text_col), text_col), []
    for r in rules:
        aggs += [F.avg(r.fails.cast("double")).alias(f"f_{r.name}"), F.avg(r.work.cast("double")).alias(f"c_{r.name}")]
    got = measured.agg(*aggs).first()
    est = [(r, got[f"f_{r.name}"] or 0.0, max(got[f"c_{r.name}"] or 0.0, 1.0)) for r in rules]
    return sorted(est, key=lambda e: (-e[1] / e[2], e[0].name))


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rejected_by``: the first rule in the given order that fails the row (null: kept)."""
    chain = F.lit(None).cast("string")
    for r in reversed(rules):
        chain = F.when(r.fails, F.lit(r.name)).otherwise(chain)
    return measured.withColumn("rejected_by", chain)
