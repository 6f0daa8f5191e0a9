"""Quality rules whose cutoffs adapt to each language and source.

Documents are measured once with built-in functions. KLL quantile sketches of
each rate are built per (language, source), merged up to languages and to the
whole corpus, and give the cutoff ``q3 + fence * (q3 - q1) + slack`` of the
narrowest level that holds ``min_docs`` documents; documents join the cutoffs
and go when a rate exceeds its own. Below ``min_docs`` in all there is no
cutoff. Sketches are exact up to their size k and off by about 1.7 / k in rank
beyond it; the measured table and the cutoffs are written before use, so one
run sees one set of cutoffs.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldshift.llm.tables import stage

SPACE = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SHOUTS = string.ascii_uppercase + "!"
WINDOW = 5
#: Rates (higher is worse) and the slack that keeps a uniformly clean group whole.
RATES = {"symbol_rate": 0.2, "dup_line_rate": 0.3, "shout_rate": 0.3}
FENCE = 3.0
MIN_DOCS = 30
SKETCH_SIZE = 2048


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, although lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _removed(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _repeat_words(hashes: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more; input: word hashes."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            def same(i: Column, by: int) -> Column:
                return F.get(pairs, i + by)["h"].eqNullSafe(F.get(pairs, i)["h"])

            at = F.transform(
                F.sequence(F.lit(0), F.size(pairs) - 1),
                lambda i: F.when(same(i, -1) | same(i, 1), F.get(pairs, i)["i"]).otherwise(-1),
            )
            return F.array_sort(F.filter(at, lambda i: i >= 0))

        return F.aggregate(
            _let(ordered, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    )
    counted = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(hashes) < WINDOW, 0).otherwise(counted)


def measures(text: Column) -> Column:
    """Struct of a text's counts; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    words = F.array_remove(F.split(text, SPACE), "")
    return F.struct(
        _let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).cast("long").alias("n_repeat_words"),
            ),
        ).alias("w"),
        _removed(text, BLANKS).cast("long").alias("word_chars"),
        (F.char_length(text) - _removed(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(text) - _removed(text, SHOUTS)).cast("long").alias("n_shouts"),
        _let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
            ),
        ).alias("l"),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Input rows with a struct ``__q``: counts, base_failed and rates. Written and read back."""
    raw = docs.withColumn("__m", measures(F.col("text")))
    m = F.col("__m")
    counts = {c: m[c] for c in ("word_chars", "n_symbols", "n_shouts")}
    counts |= {c: m["w"][c] for c in ("n_words", "n_repeat_words")} | {c: m["l"][c] for c in ("n_lines", "n_dup_lines")}
    n, ratio = counts["n_words"], lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    rates = {
        "symbol_rate": ratio(counts["n_symbols"], n),
        "dup_line_rate": ratio(counts["n_dup_lines"], counts["n_lines"]),
        "shout_rate": ratio(counts["n_shouts"], counts["word_chars"]),
    }
    failed = (n < 10) | (100 * counts["n_repeat_words"] > 20 * n)
    fields = [counts[c].alias(c) for c in COUNTS] + [failed.alias("base_failed")] + [v.alias(k) for k, v in rates.items()]
    out = raw.withColumn("__q", F.struct(*fields)).drop("__m")
    return stage(out if keep_text else out.drop("text"), "measured")


def cutoffs(rows: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Cutoff of each rate for every (lang, source) among measured rows; null: no cutoff.

    Documents that fail the base rules are left out of the sketches.
    """
    sound = F.when(~F.col("__q.base_failed"), F.lit(1))
    groups = rows.groupBy("lang", "source").agg(
        F.count(sound).alias("n"),
        *[F.kll_sketch_agg_double(F.when(sound == 1, F.col("__q")[r]), F.lit(SKETCH_SIZE)).alias(r) for r in RATES],
    )
    groups = stage(groups, "sketches")
    merged = lambda df: df.agg(
        F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_SIZE)).alias(r) for r in RATES]
    )
    langs, whole = merged(groups.where("n > 0").groupBy("lang")), merged(groups.where("n > 0").groupBy())

    def ends(df: DataFrame, level: str) -> DataFrame:
        def cutoff(r: str) -> Column:
            low, high = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (0.25, 0.75))
            return F.when(F.col("n") >= min_docs, high + fence * (high - low) + RATES[r]).alias(f"{level}_{r}")

        return df.select(*[c for c in df.columns if c in ("lang", "source")], *[cutoff(r) for r in RATES])

    out = ends(groups, "group").alias("g")
    lang, every = ends(langs, "lang").withColumnRenamed("lang", "l"), ends(whole, "all").withColumn("one", F.lit(1))
    out = out.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1)).join(every, "one", "left")
    return out.select(
        "lang", "source", *[F.coalesce(f"group_{r}", f"lang_{r}", f"all_{r}").alias(f"max_{r}") for r in RATES]
    )


def judge(docs: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS, keep_text: bool = True) -> DataFrame:
    """Every input row with the struct ``__q``: counts, rates, base_failed, kept; without its text on request.

    A null text has no words and fails the base rules; null language and source are groups like any other.
    """
    rows = measured(docs, keep_text)
    ends = stage(cutoffs(rows, fence, min_docs), "cutoffs").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    over = F.lit(False)
    for r in RATES:
        over = over | F.coalesce(F.col("__q")[r] > F.col(f"max_{r}"), F.lit(False))
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    judged = rows.join(ends, on, "left").withColumn("__q", F.col("__q").withField("kept", ~F.col("__q.base_failed") & ~over))
    return judged.select(*[c for c in docs.columns if keep_text or c != "text"], "__q")


def keep(docs: DataFrame, fence: float = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows that pass, with the input's columns."""
    return judge(docs, fence, min_docs).where("__q.kept").drop("__q")
