"""Quality rules: a table of thresholds compiled into one Spark projection.

`measures` derives the counts of a text with built-in functions only, `compiled` turns the
rows of a threshold table into one boolean column, `apply_rules` puts both together.

Defined results: a null text counts as empty (no words, fails the base rule). Rows are
judged one by one, so repeated rows and ids, null ids and extra columns pass through
unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "that", "is", "with", "for", "as", "on", "it", "was", "this", "a",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "dans", "pour", "que", "est",
    "der", "die", "das", "und", "ein", "eine", "zu", "den", "von", "mit", "ist", "des", "auf", "für",
    "el", "los", "las", "y", "en", "del", "por", "con", "para", "se", "su", "al",
)


@dataclass(frozen=True)
class Threshold:
    """A row of the table: keep texts whose measure lies in [low, high]; None is no limit."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Production table. Ratios: symbols per character in words, copied
#: lines per line with a word, repeated words, stop words and exclamation marks per word.
THRESHOLDS = (
    Threshold("n_words", low=10),
    Threshold("mean_word_chars", low=1.5, high=12.0),
    Threshold("symbol_ratio", high=0.10),
    Threshold("dup_line_ratio", high=0.50),
    Threshold("repeat_ratio", high=0.20),
    Threshold("stop_ratio", low=0.04),
    Threshold("shout_ratio", high=0.20),
)

_P = "__rule_"


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(_P + whole) == 0, F.lit(0.0)).otherwise(F.col(_P + part) / F.col(_P + whole))


def _without(text: Column, characters: str) -> Column:
    for x in characters:
        text = F.replace(text, F.lit(x), F.lit(""))
    return text


def stop_forms() -> list[str]:
    """The stop words in lower case, with a capital first letter and in capitals."""
    return list(dict.fromkeys(form for w in STOP_WORDS for form in (w, w[0].upper() + w[1:], w.upper())))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of each whole text as columns prefixed `__rule_`.

    Words in repeated windows: hashes of all 5-word windows are sorted with their
    positions, equal neighbours mark both windows, and the words they cover count once.
    The sort is skipped for texts whose hashes are all different.
    """
    c = lambda name: F.col(_P + name)
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({
        _P + "words": words_of(F.col(text)),
        _P + "lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)),
        _P + "n_symbols": (F.length(body) - F.length(_without(body, SYMBOLS))).cast("long"),
        _P + "word_chars": F.length(_without(body, SPACE)).cast("long"),
        _P + "n_shouts": (F.length(body) - F.length(_without(body, "!"))).cast("long"),
    })
    df = df.withColumns({
        _P + "n_words": F.size(c("words")).cast("long"),
        _P + "n_lines": F.size(c("lines")).cast("long"),
        _P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        _P + "hashes": F.transform(c("words"), lambda w: F.xxhash64(w)),
    }).drop(_P + "words", _P + "lines")
    stop = [F.xxhash64(F.lit(w)) for w in stop_forms()]
    df = df.withColumn(_P + "n_stop", F.size(F.filter(c("hashes"), lambda h: h.isin(*stop))).cast("long"))
    at = lambda i, k: F.get(c("hashes"), i + k)
    df = df.withColumn(
        _P + "windows",
        F.when(
            c("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), (c("n_words") - WINDOW).cast("int")), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        _P + "ranked",
        F.when(
            F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
            F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop(_P + "hashes", _P + "windows")
    same = lambda k: F.get(c("ranked"), k)["h"]
    df = df.withColumn(
        _P + "repeated",
        F.sort_array(F.filter(F.transform(c("ranked"), lambda x, k: F.when((x["h"] == same(k - 1)) | (x["h"] == same(k + 1)), x["i"])), lambda i: i.isNotNull())),
    ).drop(_P + "ranked")
    start = lambda k: F.get(c("repeated"), k)
    # A window adds the words that the one before it in the text has not covered.
    covered = F.aggregate(
        F.transform(c("repeated"), lambda i, k: F.least(F.lit(WINDOW), i - F.coalesce(start(k - 1), i - WINDOW))),
        F.lit(0),
        lambda a, b: a + b,
    )
    df = df.withColumn(_P + "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(_P + "repeated")
    return df.withColumns({
        _P + "mean_word_chars": _ratio("word_chars", "n_words"),
        _P + "symbol_ratio": _ratio("n_symbols", "word_chars"),
        _P + "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        _P + "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        _P + "stop_ratio": _ratio("n_stop", "n_words"),
        _P + "shout_ratio": _ratio("n_shouts", "n_words"),
    })


def compiled(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """One boolean column: every measure lies inside its limits."""
    verdict = F.lit(True)
    for t in thresholds:
        if t.low is not None:
            verdict = verdict & (F.col(_P + t.measure) >= t.low)
        if t.high is not None:
            verdict = verdict & (F.col(_P + t.measure) <= t.high)
    return verdict


def base_failed() -> Column:
    return (F.col(_P + "n_words") < 10) | (100 * F.col(_P + "n_repeat_words") > 20 * F.col(_P + "n_words"))


def judged(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """docs with their measures and the columns `__rule_base_failed` and `__rule_kept`."""
    df = measures(docs, text).withColumn(_P + "base_failed", base_failed())
    return df.withColumn(_P + "kept", ~F.col(_P + "base_failed") & compiled(thresholds))


def apply_rules(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    # A filter on the verdict alone would be pushed below the projections, which repeats
    # every measure in it many times over; one that needs a row number stays above them.
    df = judged(docs, thresholds, text).withColumn(_P + "row", F.monotonically_increasing_id())
    return df.where(F.col(_P + "kept") & (F.col(_P + "row") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """doc_id, the counts, the ratios and the verdict of every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop", "n_lines", "n_shouts")
    df = judged(docs.select("doc_id", "text"), thresholds)
    return df.select("doc_id", *[F.col(_P + n).alias(n) for n in names])
