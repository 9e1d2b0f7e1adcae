"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in function of the row's own text, so the plan is a scan and projections: no
shuffle, no user function, and a row of any length stays in its task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, words_of

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "de la le et les en des un du une que est pour par dans avec qui pas sur au "
    "der die und den von zu das sich mit auf für ist im nicht dem ein eine als "
    "el y los las se del por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """`low <= metric <= high`; a missing bound doesn't bind and an undefined (null) metric passes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The verdict's threshold table. Metrics are SQL over the columns of `with_metrics`.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", low=1.5, high=20.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", high=0.6),
    Rule("shout_ratio", "n_shouts / nullif(n_words, 0)", high=0.6),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", low=0.03),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_text_lines, 0)", high=0.7),
)


def compiled(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The table as two columns: does the row pass, and the names of the rules that it breaks."""
    broken = []
    for rule in rules:
        bounds = [f"{rule.metric} {op} {bound!r}" for op, bound in (("<", rule.low), (">", rule.high)) if bound is not None]
        broken.append(F.when(F.expr(" or ".join(bounds) or "false"), F.lit(rule.name)))
    names = F.array_compact(F.array(*broken)) if broken else F.expr("cast(array() as array<string>)")
    return F.size(names) == 0, names


def with_metrics(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_shouts, n_stop_words, n_text_lines, n_dup_lines, n_repeat_words.

    Null text counts as empty: all metrics are 0. Columns of these names in `docs` are replaced.
    n_repeat_words counts words in 3-word windows found twice or more in the text: equal windows have
    equal hashes, so rows without an equal hash are done; the others sort (window, position) pairs.
    """
    own = [c for c in docs.columns if c not in METRICS]
    body = text_of(text)
    keep = [F.col(f"`{c}`") for c in own]
    step = docs.select(*keep, body.alias("__text"), words_of(body).alias("__words"),
                       F.filter(F.split(body, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1))).alias("__lines"))
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.expr("cast(array() as array<int>)"))
    windows = F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    step = step.select(
        *keep, "__words", starts.alias("__starts"), windows.alias("__hashes"),
        n.cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.length("__text") - F.length(F.regexp_replace("__text", "!", ""))).cast("long").alias("n_shouts"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.size("__lines").cast("long").alias("n_text_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    ready = ["n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_text_lines", "n_dup_lines"]
    pairs = F.sort_array(F.transform("__starts", lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i"))))
    step = step.select(*keep, *ready, F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), pairs).alias("__pairs"))
    again = F.filter("__pairs", lambda x, k: F.coalesce(F.when(k > 0, F.get("__pairs", k - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce(F.get("__pairs", k + 1)["w"] == x["w"], F.lit(False)))
    step = step.select(*keep, *ready, F.sort_array(F.transform(again, lambda x: x["i"])).alias("__at"))
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    return step.select(*keep, *ready, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_text_lines", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Metrics, `base_failed`, `broken_rules` and `kept` for every row.

    An empty or null text has no words and so fails the base. Repeated rows are judged alike, an empty
    table gives an empty result, and further columns pass through.
    """
    passes, broken = compiled(rules)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = with_metrics(docs, text).withColumn("base_failed", base).withColumn("broken_rules", broken)
    return out.withColumn("kept", ~F.col("base_failed") & passes)


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of `docs` as they were, metric names included.

    A filter moves below projections and takes their expressions with it, each as often as it is used. The
    row's number, which isn't deterministic, keeps this one above them.
    """
    columns = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(text).alias("__body"))
    good = judged(boxed, "__body").withColumn("__at", F.monotonically_increasing_id()).filter("kept and __at >= 0")
    return good.select(*[F.col("__row").getField(c).alias(c) for c in columns])
