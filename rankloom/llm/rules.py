"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every metric is a column expression over the words and lines of a whole text. Words are runs of characters other than space
and tab to carriage return; a null text has none. ``compile_rules`` turns rows of the threshold table into one condition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import once

#: Words of a repeated passage.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"

# Frequent function words of English, German, French and Spanish, lower case.
STOP_WORDS = (
    "the and of to in is it a an that was for on are with as be this by at or from his her not but have has they you "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie "
    "le la les de des et un une en est que qui dans pour sur pas au avec du elle il par ce "
    "el los las una y que es por con para del se no lo su al como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text that has at least ``min_words`` words fails where ``metric`` is under ``least`` or over ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None
    min_words: int = 1


#: Texts of every length are judged; the shares wait until a text is long enough to have them.
THRESHOLDS = (
    Rule("short_words", "mean_word_chars", least=2.0),
    Rule("long_words", "mean_word_chars", most=15.0),
    Rule("symbols", "symbols_per_word", most=0.1),
    Rule("no_stop_words", "stop_word_share", least=0.01, min_words=100),
    Rule("upper_case", "upper_share", most=0.6, min_words=20),
    Rule("repeated_lines", "duplicate_line_share", most=0.6, min_words=20),
    Rule("repeated_words", "repeated_word_share", most=0.2),
    Rule("bullets", "bullet_line_share", most=0.9, min_words=20),
    Rule("vocabulary", "distinct_word_share", least=0.05, min_words=50),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def window_keys(words: Column, n: Column, bits: Column, window: int = WINDOW) -> Column:
    """The windows of a text in sorted order: a hash of the words above ``bits`` bits that hold the window's place."""

    def key(i: Column) -> Column:
        return F.call_function("shiftleft", F.xxhash64(*[F.get(words, i + k) for k in range(window)]), bits).bitwiseOR(i.cast("long"))

    return F.when(n > window, F.sort_array(F.transform(F.sequence(F.lit(0), n - window), key))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(keys: Column, bits: Column, window: int = WINDOW) -> Column:
    """Words in windows that stand twice or more in the text, every occurrence included.

    Windows are equal if their hashes are: 64 bits less those of the place, 54 for a text of a thousand words. The places of
    repeated windows, in order, cover as many new words as they lie apart, ``window`` at most.
    """

    def same(x: Column, i: Column) -> Column:
        of = lambda c: F.call_function("shiftright", c, bits)
        return (of(x) == of(F.get(keys, i + 1))) | (of(x) == of(F.get(keys, i - 1)))

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    places = F.sort_array(F.transform(F.filter(keys, same), lambda x: x.bitwiseAND(mask)))
    start = F.struct(F.lit(-window).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    add = lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(i - acc["last"], F.lit(window).cast("long"))).alias("sum"))
    return F.aggregate(places, start, add, lambda acc: acc["sum"])


def measure(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the counts that the metrics are made of; columns of their names are replaced. Rows are neither dropped nor joined."""
    names = [prefix + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lines", "_stop", "_upper", "_bullets", "_distinct")]
    keep = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {x.lower() for x in names}])
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(SPACE))
    # each explode holds a costly array, so that later expressions read it instead of computing it anew
    split = once(keep, _w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")), _l=F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    w, n = F.col("_w"), F.size("_w")
    split = once(split.withColumn("_b", F.length(F.bin(n.cast("long")))), _k=window_keys(w, n, F.col("_b")))
    stop = sorted({v for s in STOP_WORDS for v in (s, s.capitalize())})
    edge = F.lit(".,;:!?\"'()")
    counts = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[" + SYMBOLS + "]")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_k"), F.col("_b")),
        "_lines": F.size("_l").cast("long"),
        "_stop": F.size(F.filter(w, lambda x: F.btrim(x, edge).isin(stop))).cast("long"),
        "_upper": F.regexp_count(whole, F.lit("\\p{Lu}")).cast("long"),
        "_bullets": F.size(F.filter("_l", lambda x: F.btrim(x, F.lit(SPACE)).rlike("^[-*•]"))).cast("long"),
        "_distinct": F.size(F.array_distinct(w)).cast("long"),
    }
    return once(split, **{prefix + k: v for k, v in counts.items()}).drop("_w", "_l", "_k", "_b")


def metrics(prefix: str = "") -> dict[str, Column]:
    """The ratios that rules name, over the counts of ``measure``; a text without words or lines has 0."""
    c = lambda name: F.col(prefix + name)
    return {
        "n_words": c("n_words"),
        "mean_word_chars": _share(c("word_chars"), c("n_words")),
        "symbols_per_word": _share(c("n_symbols"), c("n_words")),
        "stop_word_share": _share(c("_stop"), c("n_words")),
        "upper_share": _share(c("_upper"), c("word_chars")),
        "duplicate_line_share": _share(c("n_dup_lines"), c("_lines")),
        "repeated_word_share": _share(c("n_repeat_words"), c("n_words")),
        "bullet_line_share": _share(c("_bullets"), c("_lines")),
        "distinct_word_share": _share(c("_distinct"), c("n_words")),
    }


def compile_rules(rules: tuple[Rule, ...] = THRESHOLDS, prefix: str = "") -> dict[str, Column]:
    """One failing condition per rule of the table."""
    known, out = metrics(prefix), {}
    for r in rules:
        if r.metric not in known or (r.least is None) == (r.most is None) or r.name in out:
            raise ValueError(f"rule {r.name}: one bound of a known metric under a name of its own is needed")
        value = known[r.metric]
        bad = value < F.lit(r.least) if r.least is not None else value > F.lit(r.most)
        out[r.name] = (F.col(prefix + "n_words") >= r.min_words) & bad
    return out


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """Add counts, ``base_failed``, ``failed_rules`` (names in table order) and ``kept``; columns of these names are replaced.

    The base test comes first: under 10 words, or more than a fifth of the words in repeated windows. Null and empty texts
    have no words and so fail it. Every row is judged by itself; repeated rows stay.
    """
    measured = measure(df, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in compile_rules(rules).items()]))
    gone = {"base_failed", "failed_rules", "kept"}
    columns = [F.col(f"`{c}`") for c in measured.columns if c.lower() not in gone]
    judged = measured.select(*columns, base.alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_lines", "_stop", "_upper", "_bullets", "_distinct")
