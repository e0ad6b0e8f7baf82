"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document is measured: words, symbols, repeated lines, words in repeated windows. Fixed rules reject the plainly bad
(base_failed). The others are held against thresholds that follow the data: for every (lang, source) and metric a KLL
quantile sketch is built over the documents that passed the fixed rules; sketches merge into one for each language and
one for all, and a group with too few documents takes the sketch of its language, or else that of all. A metric is out
of bounds beyond a fence: the median and a multiple of the distance from it to a high quantile, and for the word length
also to a low one. The quantile is that of the metric: repeats are rare, so that only a far one differs from 0, while
symbols take the upper quartile, since text of symbols can be a tenth of a source and would hide in a farther one. A guard
is the least distance from the median that counts, for groups whose values are all alike. A document is rejected if a
metric is out of bounds.

The thresholds, a row for each group, are written to the shared folder before they are joined, so that a task that runs
again sees the same ones. The join is on (lang, source), null-safe, against this small table: Spark broadcasts it while
it is under the session's limit, and otherwise joins by shuffle, where adaptive execution splits a hot source.

Defined results: null and empty texts have no words and fail the fixed rules. A null lang or source is a group of its
own. Repeated rows are judged alike. A table of which nothing passes the fixed rules has no thresholds, and then only
these rules decide; an empty table has no rows. Very long texts are measured whole. Other columns are passed through, by
keep_good() whatever their names are; apply_rules() adds the measures in place of columns of the same name.

KLL sketches compact at random, within their error (about 0.3 % of ranks at the default size): a document that lies just
at a fence may be judged otherwise when the table is read anew. Within a run the thresholds are written, so they are one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import WORD
from knotwork.session import materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Fence:
    """quantile: the high one; its distance from the median times `times` is the farthest allowed, or guard if that is more.
    low: whether 1 - quantile bounds the metric from below in the same way."""

    quantile: float
    times: float
    guard: float
    low: bool = False


@dataclass(frozen=True)
class QualityLimits:
    """min_words and max_repeat_percent: the fixed rules. window: words of a repeated window. least_group: documents that a
    group needs for thresholds of its own. sketch_size: k of the sketches. fences: for each metric."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    least_group: int = 200
    sketch_size: int = 800
    fences: tuple[tuple[str, Fence], ...] = (
        ("symbols", Fence(0.75, 7.0, 0.02)),
        ("dup_lines", Fence(0.99, 1.25, 0.10)),
        ("repeats", Fence(0.99, 1.25, 0.05)),
        ("word_length", Fence(0.90, 4.0, 0.5, low=True)),
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for the row, however often use names it and wherever."""
    return F.transform(F.array(value), use)[0]


def measure(df: DataFrame, window: int = 8, text: str = "text") -> DataFrame:
    """Adds MEASURES. Work is linear in the text, but for a sort of the window hashes of a text that repeats one."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in df.columns if c.lower() not in MEASURES]
    out = df.select(*(F.col(f"`{c}`") for c in kept), F.regexp_extract_all(t, F.lit(f"({WORD})"), 1).alias("_words"), F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"))
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    })
    last = F.size("_words") - window + 1
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    windows = _with(hashes, lambda h: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(h, i, window))))
    out = out.withColumn("_windows", F.when(last > 0, windows).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    out = out.withColumn("_sorted", F.when(repeats, ordered).otherwise(none))

    def same(x: Column, other: Column) -> Column:
        """Equal hashes, and then equal words."""
        return (other["h"] == x["h"]) & (F.slice("_words", other["p"], window) == F.slice("_words", x["p"], window))

    def found_twice(x: Column, i: Column) -> Column:
        before, after = F.get("_sorted", i - 1), F.get("_sorted", i + 1)
        return F.coalesce(same(x, before), F.lit(False)) | F.coalesce(same(x, after), F.lit(False))

    def covered(starts: Column) -> Column:
        """Words that the windows beginning at starts cover, each once."""
        each = F.transform(starts, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - p, F.lit(window))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    starts = F.sort_array(F.transform(F.filter("_sorted", found_twice), lambda x: x["p"]))
    out = out.withColumn("n_repeat_words", F.when(F.size("_sorted") > 0, _with(starts, covered)).otherwise(0).cast("long"))
    return out.drop("_words", "_lines", "_windows", "_sorted")


def metrics() -> dict[str, Column]:
    """The metrics as expressions over MEASURES; null where undefined."""
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return {
        "symbols": F.col("n_symbols") / F.when(F.col("word_chars") > 0, F.col("word_chars")),
        "dup_lines": F.col("n_dup_lines") / F.when(F.col("n_lines") > 0, F.col("n_lines")),
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def base_failed(limits: QualityLimits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def thresholds(measured: DataFrame, limits: QualityLimits) -> DataFrame:
    """A row for each (lang, source): for each metric the lowest (null if any is) and the highest value allowed.

    Sketches are built by partial aggregation in each task and merged; those of a language and of all are merges of them.
    """
    passed = measured.where(~base_failed(limits)).select("lang", "source", *(c.alias(f"_{m}") for m, c in metrics().items()))
    names, fences = list(metrics()), dict(limits.fences)
    groups = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *(F.kll_sketch_agg_double(f"_{m}", F.lit(limits.sketch_size)).alias(m) for m in names))
    groups = materialize(groups, "quality-sketches")

    def merged(*by: str) -> DataFrame:
        return groups.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(limits.sketch_size)).alias(m) for m in names))

    def bounds(df: DataFrame, *by: str) -> DataFrame:
        def bound(m: str) -> Column:
            fence = fences[m]
            middle, low, high = (F.kll_sketch_get_quantile_double(F.col(m), F.lit(q)) for q in (0.5, 1 - fence.quantile, fence.quantile))
            lowest = middle - F.greatest(F.lit(fence.guard), fence.times * (middle - low)) if fence.low else F.lit(None).cast("double")
            return F.struct(lowest.alias("low"), (middle + F.greatest(F.lit(fence.guard), fence.times * (high - middle))).alias("high"))

        # without a document there is no quantile to ask for: such a limit is null
        return df.select(*by, "n", F.when(F.col("n") > 0, F.struct(*(bound(m).alias(m) for m in names))).alias("limit"))

    own = bounds(groups, "lang", "source").alias("own")
    tongue = bounds(merged("lang"), "lang").alias("tongue")
    every = bounds(merged(), *()).alias("every")
    joined = own.join(F.broadcast(every), F.lit(True)).join(tongue, F.col("own.lang").eqNullSafe(F.col("tongue.lang")))
    enough = F.lit(limits.least_group)
    chosen = F.when(F.col("own.n") >= enough, F.col("own.limit")).when(F.col("tongue.n") >= enough, F.col("tongue.limit")).otherwise(F.col("every.limit"))
    return materialize(joined.select(F.col("own.lang").alias("_lang"), F.col("own.source").alias("_source"), chosen.alias("_limit")), "quality-thresholds")


def judge(measured: DataFrame, limits: QualityLimits, bounds: DataFrame) -> DataFrame:
    """Adds base_failed and kept. A group without thresholds (none of its documents passed the fixed rules) has none to break."""
    joined = measured.join(bounds, measured["lang"].eqNullSafe(bounds["_lang"]) & measured["source"].eqNullSafe(bounds["_source"]), "left")
    breaks = [F.coalesce(c > F.col(f"_limit.{m}.high"), F.lit(False)) | F.coalesce(c < F.col(f"_limit.{m}.low"), F.lit(False)) for m, c in metrics().items()]
    odd = breaks[0]
    for b in breaks[1:]:
        odd = odd | b
    return joined.withColumn("base_failed", base_failed(limits)).withColumn("kept", ~F.col("base_failed") & ~odd).drop("_lang", "_source", "_limit")


def _measured_rows(df: DataFrame, limits: QualityLimits, text: str) -> DataFrame:
    """df's rows as one struct, _row, beside lang, source and MEASURES: so names in df and names of measures never meet.

    Written once, for the sketches and for the join; a filter over the measures can't be pushed below them either."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), "lang", "source", F.col(f"`{text}`").alias("_text"))
    return materialize(measure(rows, limits.window, "_text").drop("_text"), "quality-measures")


def apply_rules(df: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text") -> DataFrame:  # noqa: B008
    """df with MEASURES, base_failed and kept, in place of columns of these names; df needs lang and source."""
    measured = _measured_rows(df, limits, text)
    added = (*MEASURES, "base_failed", "kept")
    own = [F.col(f"_row.`{c}`") for c in df.columns if c.lower() not in added]
    return judge(measured, limits, thresholds(measured, limits)).select(*own, *added)


def keep_good(df: DataFrame, limits: QualityLimits = QualityLimits(), text: str = "text") -> DataFrame:  # noqa: B008
    """The rows of df that are kept, with their own columns, whatever their names."""
    measured = _measured_rows(df, limits, text)
    return judge(measured, limits, thresholds(measured, limits)).where("kept").select(*(F.col(f"_row.`{c}`") for c in df.columns))


def verdicts(df: DataFrame, limits: QualityLimits = QualityLimits(), key: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """The verdicts without the texts: the measures are written once and serve both the sketches and the join."""
    slim = measure(df.select(F.col(f"`{key}`"), "lang", "source", F.col(f"`{text}`")), limits.window, text).drop(text)
    slim = materialize(slim, "quality-measures")
    return judge(slim, limits, thresholds(slim, limits))
