"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that for it with on was as be by are this an at from or "
    "der die das und ist nicht von mit den ein eine zu im für auf dem sich "
    "le la les de des et un une est que pour dans en du au sur pas par "
    "el los las y que del se un una por con no su al"
).split()

#: Gaps between words other than one space.
LONG_GAP = r"[\t-\r][ \t-\r]*| [ \t-\r]+"

#: Low bits of a sort key that hold a position.
PLACE_BITS = 20


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= value of the metric <= high; an absent bound does not count."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds on the metrics of ``measures``.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.3),
    Rule("bang_ratio", None, 0.5),
    Rule("pipe_ratio", None, 0.25),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once although the body names it often."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    return let(
        F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, LONG_GAP, " "), " ")),
    )


def covered_words(starts: Column) -> Column:
    """Words covered by 3-word windows at these distinct starts: a sum of gaps of at most three."""
    return let(
        F.sort_array(starts),
        lambda p: F.aggregate(
            F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("int")),
            F.lit(0),
            lambda acc, x: acc + x,
        ),
    )


def repeat_words_by_text(words: Column) -> Column:
    """As ``repeat_words``, sorting the windows' words themselves: slower, and needs no hash."""
    key = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2], F.lit(""))
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(key(i).alias("g"), i.cast("long").alias("p")))
    same = lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))
    repeated = lambda s: F.filter(
        F.transform(s, lambda x, i: F.when(same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x), x["p"])),
        lambda p: p.isNotNull(),
    )
    return covered_words(let(F.sort_array(grams), repeated))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_pipes", "n_stop_words", "n_lines")

MASK = (1 << PLACE_BITS) - 1


def window_keys(words: Column) -> Column:
    """Sorted keys of the 3-word windows: the upper bits of a window's hash above its position."""
    key = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.lit(~MASK)).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)), key))


def equal_neighbours(keys: Column) -> Column:
    """Pairs of positions, in one long each, of neighbouring keys with equal hash bits."""
    pair = lambda a, b: F.when(
        F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0,
        F.shiftleft(a.bitwiseAND(F.lit(MASK)), PLACE_BITS).bitwiseOR(b.bitwiseAND(F.lit(MASK))),
    )
    return F.filter(F.zip_with(keys, F.slice(keys, 2, F.size(keys)), pair), lambda p: p.isNotNull())


def repeat_words(words: Column, pairs: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, from ``equal_neighbours``.

    Neighbours with equal hash bits are compared word by word; a text in which they differ, or that has more words than
    a key can number, is counted from its words instead, so the result is exact for every text.
    """
    first, second = (lambda p: F.shiftright(p, PLACE_BITS).cast("int")), (lambda p: p.bitwiseAND(F.lit(MASK)).cast("int"))
    differ = lambda p: ~(
        (words[first(p)] == words[second(p)])
        & (words[first(p) + 1] == words[second(p) + 1])
        & (words[first(p) + 2] == words[second(p) + 2])
    )
    starts = F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(first(p), second(p)))))
    return (
        F.when(F.size(words) < 3, F.lit(0))
        .when(F.size(words) > MASK, repeat_words_by_text(words))
        .when(F.size(pairs) == 0, F.lit(0))
        .when(F.exists(pairs, differ), repeat_words_by_text(words))
        .otherwise(covered_words(starts))
    )


def measured(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The columns ``keep`` and ``m``, a struct of counts of ``text`` (null: no words)."""
    clean = F.coalesce(F.col("t"), F.lit(""))
    steps = docs.select(*keep, text.alias("t")).withColumn("words", split_words(F.col("t")))
    steps = steps.withColumn("lines", F.filter(F.split(clean, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    steps = steps.withColumn("keys", window_keys(F.col("words"))).withColumn("pairs", equal_neighbours(F.col("keys")))
    words, lines = F.col("words"), F.col("lines")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(clean, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words, F.col("pairs")),
        "n_bangs": F.regexp_count(clean, F.lit("!")),
        "n_pipes": F.size(F.filter(words, lambda w: w == "|")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_lines": F.size(lines),
    }
    return steps.select(*[c for c in steps.columns if c not in ("t", "words", "lines", "keys", "pairs")], fenced(counts).alias("m"))


def fenced(counts: dict[str, Column]) -> Column:
    """The counts in a struct with a row number, by which the optimizer takes the struct for non-deterministic: a filter
    on it stays above the projection and does not measure the text again for every rule."""
    return F.struct(*[c.cast("long").alias(k) for k, c in counts.items()], F.monotonically_increasing_id().alias("at"))


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column, Column]:
    """(base_failed, array of the names of broken rules, kept) from a struct of ``measures``.

    Ratios of a text without words or lines are 0, except that its mean word length is absent and breaks no rule.
    """
    words = F.greatest(m["n_words"], F.lit(1))
    ratio = {
        "mean_word_chars": m["word_chars"] / F.when(m["n_words"] > 0, m["n_words"]),
        "symbol_ratio": m["n_symbols"] / words,
        "bang_ratio": m["n_bangs"] / words,
        "pipe_ratio": m["n_pipes"] / words,
        "stop_word_ratio": m["n_stop_words"] / words,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
        "repeat_word_ratio": m["n_repeat_words"] / words,
    }
    failed = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)

    def broken(rule: Rule) -> Column:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (ratio[rule.metric] < rule.low)
        if rule.high is not None:
            bad = bad | (ratio[rule.metric] > rule.high)
        return F.when(bad, F.lit(rule.metric))

    names = F.array_compact(F.array(*[broken(r) for r in rules])) if rules else F.array().cast("array<string>")
    return failed, names, ~failed & (F.size(names) == 0)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: the id, the counts, base_failed, kept and the names of broken rules.

    A null or empty text has no words: its counts are 0 and it fails. A null id stays null; repeated rows are judged
    each; other columns are not read; an empty table gives an empty result. One pass, no shuffle.
    """
    rows = measured(docs, F.col(text_col), F.col(id_col).alias("id"))
    failed, names, kept = verdict(F.col("m"), rules)
    return rows.select(F.col("id").alias(id_col), *[F.col("m")[f].alias(f) for f in FIELDS], failed.alias("base_failed"), kept.alias("kept"), names.alias("broken_rules"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text passes the base checks and every rule."""
    rows = measured(docs, F.col(text_col), F.struct("*").alias("row"))
    return rows.filter(verdict(F.col("m"), rules)[2]).select("row.*")
