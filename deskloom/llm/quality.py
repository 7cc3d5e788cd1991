"""Quality rules with adaptive thresholds, DataFrame functions only.

Base counts of every whole text are computed in the row. Each (lang, source) group then gets
KLL quantile sketches of three measures; the sketches of a language's sources merge to its
own, and those to one for the corpus, so a group below ``LEAST_ROWS`` rows uses the next wider
one. A text is kept if it passes the base rule and each measure stays below its fence:
``high + reach * max(high - median, tie)`` with the group's quantile ``HIGH``, which has to lie
below the poor texts of a group.

The measures are logarithms. Rates count half an event and one more word (or line), so a text
without symbols has a rate that its length allows, not zero: quantiles of a group differ although
most of its texts hold no symbol, the fence follows from them, and a symbol or two in a short
text is no outlier. The tie only matters where quantiles are equal, in groups of like texts.

Sketches are partial aggregates, so a hot source costs one small state per task. The fences
are one row per group and join back by null-safe keys.

Null and wordless texts have zero counts and fail the base rule. Null lang or source is a group
of its own. Repeated rows are judged one by one, each with the same verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.llm.common import written

#: Base rule: fewest words, most percent of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows that a group needs for fences of its own; size of a sketch's levels.
LEAST_ROWS, SKETCH_K = 200, 400
HIGH = 0.8
#: Measure: reach of its fence, and least distance of the quantiles.
MEASURES = {"symbol_rate": (3.5, 0.1), "dup_line_rate": (3.5, 0.1), "word_length": (8.0, 0.01)}

_SPACES = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` names it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    Windows are sorted by hash and compared word by word with their neighbours; the covered
    length is the union of the repeated windows. Time grows as n log n with the text.
    """

    def same(a: Column, b: Column) -> Column:
        at = [F.get(words, a + k) == F.get(words, b + k) for k in range(3)]
        return at[0] & at[1] & at[2]

    def twin(p: Column, q: Column) -> Column:
        return F.coalesce((p["h"] == q["h"]) & same(p["i"], q["i"]), F.lit(False))

    def covered(ordered: Column) -> Column:
        found = F.filter(
            ordered, lambda p, j: twin(p, F.get(ordered, j - 1)) | twin(p, F.get(ordered, j + 1))
        )
        starts = F.array_sort(F.transform(found, lambda p: p["i"]))
        nothing = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        return F.aggregate(
            starts,
            nothing,
            lambda a, i: F.struct(
                (i + 3).alias("end"), (a["total"] + i + 3 - F.greatest(a["end"], i)).alias("total")
            ),
            lambda a: a["total"],
        )

    def ordered(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(hashes: Column) -> Column:
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, let(ordered(hashes), covered)).otherwise(0)

    heads = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, count)


def counts(text: Column) -> Column:
    """Struct of the base counts of a text."""
    filled = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = F.filter(F.split(filled, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    return F.struct(
        let(words_of(filled), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        F.regexp_count(filled, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _measures() -> dict[str, Column]:
    return {
        "symbol_rate": F.log((F.col("n_symbols") + 0.5) / (F.col("n_words") + 1)),
        "dup_line_rate": F.log((F.col("n_dup_lines") + 0.5) / (F.col("n_lines") + 1)),
        "word_length": F.log(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
    }


def _fence(sketch: Column, reach: float, tie: float) -> Column:
    middle, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.5, HIGH))
    return high + reach * F.greatest(high - middle, F.lit(tie))


def fences(measured: DataFrame, lang: str, source: str, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(lang, source, one fence per measure) of each group of ``measured``."""
    sketch = [F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(name) for name in MEASURES]
    merge = [F.kll_merge_agg_double(name, F.lit(SKETCH_K)).alias(name) for name in MEASURES]
    sound = F.count_if(~F.col("base_failed")).alias("n")
    usable = measured.select(
        F.col(lang).alias("g_lang"),
        F.col(source).alias("g_source"),
        "base_failed",
        *[F.when(~F.col("base_failed"), F.col(name)).alias(name) for name in MEASURES],
    )
    groups = written(usable.groupBy("g_lang", "g_source").agg(sound, *sketch), "sketches")
    langs = groups.groupBy("g_lang").agg(F.sum("n").alias("n"), *merge)
    corpus = groups.agg(F.sum("n").alias("n"), *merge)

    def fenced(df: DataFrame, level: str) -> DataFrame:
        wide = F.col("n") >= (least_rows if level != "corpus" else 1)
        each = [F.when(wide, _fence(F.col(m), *how)).alias(f"{level}_{m}") for m, how in MEASURES.items()]
        return df.select(*[c for c in df.columns if c.startswith("g_")], *each)

    by_group, by_lang = fenced(groups, "group"), fenced(langs, "lang").withColumnRenamed("g_lang", "l_lang")
    wider = by_group.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).join(
        F.broadcast(fenced(corpus, "corpus")), F.lit(True)  # one row
    )
    return wider.select(
        "g_lang",
        "g_source",
        *[F.coalesce(*[F.col(f"{level}_{m}") for level in ("group", "lang", "corpus")]).alias(f"{m}_fence") for m in MEASURES],
    )


def judged(
    docs: DataFrame, keep: Sequence[str], text: str = "text", lang: str = "lang", source: str = "source", **options
) -> DataFrame:
    """(row struct of ``keep``, base counts, base_failed, kept) of every row."""
    counted = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{lang}`").alias("r_lang"),
        F.col(f"`{source}`").alias("r_source"),
        counts(F.col(f"`{text}`")).alias("c"),
    )
    flat = counted.select("row", "r_lang", "r_source", "c.words.*", "c.lines.*", "c.n_symbols")
    flat = flat.withColumn("base_failed", base_failed())
    measured = written(flat, "counts").select("*", *[v.alias(k) for k, v in _measures().items()])
    limits = written(fences(measured, "r_lang", "r_source", **options), "fences")
    same = F.col("r_lang").eqNullSafe(F.col("g_lang")) & F.col("r_source").eqNullSafe(F.col("g_source"))
    below = ~F.col("base_failed")
    for name in MEASURES:
        below = below & F.coalesce(F.col(name) <= F.col(f"{name}_fence"), F.lit(True))
    return measured.join(limits, same, "left").select("row", *COUNTS, "base_failed", below.alias("kept"))


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The kept rows of ``docs``; columns unchanged."""
    return judged(docs, docs.columns, **options).filter("kept").select("row.*")
