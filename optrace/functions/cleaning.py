"""Prediction cleaning and the two scores, per row and without Python on the workers.
The steps are Column functions; the two compositions take and return DataFrames.

NULL predictions stay NULL throughout; an expected text decides the route."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optrace import constants as K
from optrace.functions.text import BLANK, BLANK_CHARS, LINE_BREAK, cut_right, first_bytes, from_byte, lines, printable_at, strip, strip_plain, strip_right, strip_right_plain

# The others are mostly far into a text or not in it, so that looking for them takes a walk over it.
FREQUENT = " abcdefghiklmnoprstuvwy"
# Line ends other than the line feed, looked for one by one: that is cheaper than a pattern.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
THINK = r"(?i)<think>[\s\S]*?(</think>|\z)"
OPENED_LINE = r"(?i)(?:\A|(?<=\n))[\s\x1c-\x1f\x85\p{Z}&&[^\n]]*<think[^\n]*(?:\n|\z)"
# At the very start a match needs no line feed; elsewhere one of two rare characters is looked for first.
CHATTER_START, START_BYTES = r"(?i)\A(?:Answer:|Explanation:)", 12
CHATTER = r"(?=[\n\[])(?i:\[EOF\]|\n(?:Answer:|Explanation:))"
STATE_START, STATE_END = "<filesystem", "</filesystem>"
ARRAY_PATTERN = r"\[[\s\S]*?\]"


def strip_think(c: Column) -> Column:
    """Reasoning blocks removed, closed or not, and lines that start one; then stripped.
    Line ends become line feeds."""
    text = F.regexp_replace(F.regexp_replace(c, THINK, ""), LINE_BREAK, "\n")
    return F.when(~_may_think(c) & ~_has_line_ends(c), strip_plain(c)).otherwise(strip(F.regexp_replace(text, OPENED_LINE, "")))


def _may_think(c: Column) -> Column:
    return (c.contains("<t") | c.contains("<T")) & c.rlike("(?i)<think")


def _has_line_ends(c: Column) -> Column:
    found = F.lit(False)
    for end in LINE_ENDS:
        found = found | c.contains(end)
    return found


def strip_chatter(c: Column) -> Column:
    """Text before the first [EOF], or line-opening Answer: or Explanation:."""
    return strip(_before_chatter(c))


def _before_chatter(c: Column) -> Column:
    """Without the line feed that precedes the chatter."""
    # Without a bracket and a colon there is nothing to look for.
    starts = F.substring(c.cast("binary"), 1, START_BYTES).cast("string").rlike(CHATTER_START)
    before = F.when(starts, "").otherwise(F.get(F.split(c, CHATTER, 2), F.lit(0)))
    return F.when(c.contains("[") | c.contains(":"), before).otherwise(c)


def is_state(c: Column) -> Column:
    """Does the text look like a rendered state, in XML or as a tree?"""
    begins = c.startswith("/") | (F.substring(c.cast("binary"), 1, 11) == F.lit(b"<filesystem"))
    return F.coalesce(F.when(printable_at(c, 1), begins).otherwise(c.rlike(r"^[\s\x1c-\x1f\x85\p{Z}]*(?:<filesystem|/)")), F.lit(False))


def extract_state(c: Column) -> Column:
    """First <filesystem ...> document, to its end tag or else to the end of the text."""
    text = strip(c)
    block = F.regexp_extract(text, r"(?s)<filesystem.*?(?:</filesystem>|\z)", 0)
    return F.when(block == "", text).otherwise(strip(block))


def extract_tree(c: Column) -> Column:
    """Older extraction: closed reasoning blocks removed, then from the first line that
    starts with '/'; the whole text if no line does."""
    text = F.regexp_replace(c, r"(?i)<think>[\s\S]*?</think>", "")
    parts = lines(text)
    tags = F.transform(parts, lambda line: strip(line).startswith("/"))
    first = F.coalesce(F.nullif(F.array_position(tags, F.lit(True)).cast("int"), F.lit(0)), F.lit(1))
    return strip(F.array_join(F.slice(parts, first, F.greatest(F.size(parts), F.lit(1))), "\n"))


def strip_stop(c: Column, mode: str = "trailing") -> Column:
    """'trailing': right-stripped and without a final stop token; 'first': the text before
    the first token, stripped when there is one."""
    if mode == "first":
        return F.when(c.contains(K.STOP_TOKEN), strip(F.substring_index(c, K.STOP_TOKEN, 1))).otherwise(c)
    if mode != "trailing":
        raise ValueError(f"unknown mode {mode!r}")
    right = strip_right(c)
    cut = first_bytes(right, F.octet_length(right) - len(K.STOP_TOKEN))
    return F.when(right.endswith(K.STOP_TOKEN), strip_right(cut)).otherwise(right)


def strip_stop_plain(c: Column) -> Column:
    """As strip_stop, for a plain column."""
    return F.when(printable_at(c, -1) & ~c.endswith(K.STOP_TOKEN), c).otherwise(cut_right(c, strip_stop))


def clean_read(c: Column) -> Column:
    return strip(c)


def _names(c: Column) -> Column:
    return F.array_sort(F.from_json(c, "array<string>", {"allowSingleQuotes": "false"}))


def repair_listing(pred: Column, exp: Column) -> Column:
    """An array equal to the expected text wins; else one with the same names in any order
    gives the expected text; else the first array; else the stripped text."""
    text, wanted = strip(pred), strip(exp)
    arrays = F.regexp_extract_all(text, F.lit(ARRAY_PATTERN), 0)
    wanted_names = _names(wanted)
    exact = F.exists(arrays, lambda a: a == wanted)
    same = F.exists(arrays, lambda a: F.coalesce(_names(a) == wanted_names, F.lit(False)))
    return (
        F.when((F.coalesce(exp, F.lit("")) != "") & (exact | same), wanted)
        .when(F.size(arrays) > 0, F.get(arrays, F.lit(0)))
        .otherwise(text)
    )


def clamp(pred: Column, exp: Column) -> Column:
    """Expected text if the prediction contains it; '' if that is what is expected."""
    p, e = strip(pred), strip(exp)
    return (
        F.when(pred.isNull() | exp.isNull(), pred)
        .when(e == "", "")
        .when(p.contains(e), e)
        .otherwise(p)
    )


def with_clean_prediction(df: DataFrame, pred: str = "predicted", exp: str = "expected", out: str = "predicted") -> DataFrame:
    """Reasoning and chatter removed, then the route of the expected shape. Each step is a
    column of its own: inlined into one expression the plan would repeat them many times."""
    bare, wanted, state = F.col("_bare"), F.col("_wanted"), F.col("_state")
    # extract_state and strip_stop of states, by plain searches and step by step for the same reason.
    text, rest, found, end = F.col("_text"), F.col("_rest"), F.col("_found"), F.lit(STATE_END)
    once = rest.endswith(end) & ~first_bytes(rest, F.octet_length(rest) - len(STATE_END)).contains(end)
    block = F.when(once, rest).when(rest.contains(end), F.concat(F.substring_index(rest, STATE_END, 1), end)).otherwise(rest)
    routed = (
        F.when(state, strip_stop_plain(found))
        .when(wanted.startswith("["), repair_listing(bare, wanted))
        .otherwise(bare)
    )
    target = F.when(state, strip_stop_plain(F.col(exp))).otherwise(F.col(exp))
    clamped = (
        F.when(wanted == "", "")
        .when(F.col("_routed").isNull() | F.col(exp).isNull(), F.col("_routed"))
        .when(F.col("_p").contains(F.col("_e")), F.col("_e"))
        .otherwise(F.col("_p"))
    )
    return (
        # strip_think: a pattern is tried only where something that it needs is left.
        df.withColumn("_bare", F.when(_may_think(F.col(pred)), F.regexp_replace(F.col(pred), THINK, "")).otherwise(F.col(pred)))
        .withColumn("_bare", F.when(_has_line_ends(bare), F.regexp_replace(bare, LINE_BREAK, "\n")).otherwise(bare))
        .withColumn("_bare", F.when(_may_think(bare), F.regexp_replace(bare, OPENED_LINE, "")).otherwise(bare))
        .withColumn("_bare", strip_plain(bare))
        .withColumn("_bare", _before_chatter(bare))
        .withColumns({"_bare": strip_plain(bare), "_wanted": strip_plain(F.col(exp)), "_state": is_state(F.col(exp))})
        # What is stripped above has no outer blanks left, and neither has what is cut out of it here.
        .withColumn("_text", F.when(state, bare))
        .withColumn("_at", F.octet_length(F.substring_index(text, STATE_START, 1)))
        .withColumn("_rest", F.when(F.col("_at") == 0, text).otherwise(from_byte(text, F.col("_at"))))
        .withColumn("_found", F.when(rest == "", text).otherwise(block))
        .withColumns({"_routed": routed, "_target": target})
        .withColumns({"_p": strip_plain(F.col("_routed")), "_e": strip_plain(F.col("_target"))})
        .withColumn(out, clamped).drop("_bare", "_wanted", "_state", "_text", "_at", "_rest", "_found", "_routed", "_target", "_p", "_e")
    )


def expected_for_scoring(exp: Column, strip_token: bool = True) -> Column:
    """States lose their stop token before scoring. With strip_token=False they keep it, as
    in the second evaluator, where no state can therefore match exactly."""
    return F.when(is_state(exp), strip_stop_plain(exp)).otherwise(exp) if strip_token else exp


def exact_match(pred: Column, exp: Column) -> Column:
    return F.coalesce((pred == exp) | (strip_plain(pred) == strip_plain(exp)), F.lit(False))


def with_similarity(df: DataFrame, pred: str, exp: str, out: str = "similarity") -> DataFrame:
    """1.0 for texts equal up to whitespace (or both empty), 0.0 if one is empty, else the
    Jaccard index of their lower-case character sets.

    Texts equal up to whitespace have the same characters, so whitespace need not be folded to find them: any of it
    inside a text counts as one space among the characters."""
    p, e = F.col("_p"), F.col("_e")

    def bare(c: str) -> Column:
        # Equal texts need no further look.
        return F.when(F.col(pred) != F.col(exp), strip_plain(F.col(c)))

    def rest(c: Column) -> Column:
        """What is not frequent, in lower case. The case of a character depends on no other, but for the sigma."""
        return F.lower(F.when(c.contains("\u03a3"), c).otherwise(F.regexp_replace(c, f"[{FREQUENT}{FREQUENT.strip().upper()}]+", "")))

    def found(c: Column, low: Column) -> Column:
        """Different characters: the most frequent ones are looked for, all others may repeat."""
        letters = [F.when(c.contains(x) | c.contains(x.upper()) | low.contains(x), x).otherwise("") for x in FREQUENT.strip()]
        blank = F.when(c.contains(" ") | low.rlike(BLANK), " ").otherwise("")
        return F.concat(blank, *letters, F.regexp_replace(low, f"[{FREQUENT}{BLANK_CHARS}]+", ""))

    def characters(c: str) -> Column:
        # An all-blank text has no characters, though split('') yields one empty string.
        return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(c, "")))

    common, either = F.col("_common"), F.size("_p_chars") + F.size("_e_chars") - F.col("_common")
    p_empty = F.coalesce(F.col(pred) == "", F.lit(True))
    e_empty = F.coalesce(F.col(exp) == "", F.lit(True))
    value = (
        F.when(p_empty & e_empty, 1.0).when(p_empty | e_empty, 0.0).when((F.col(pred) == F.col(exp)) | (either == 0), 1.0)
        .otherwise(common / either)
    )
    return (
        df.withColumns({"_p": bare(pred), "_e": bare(exp)})
        .withColumns({"_p_rest": rest(p), "_e_rest": rest(e)})
        .withColumns({"_p_rest": found(p, F.col("_p_rest")), "_e_rest": found(e, F.col("_e_rest"))})
        .withColumns({"_p_chars": characters("_p_rest"), "_e_chars": characters("_e_rest")})
        .withColumn("_common", F.size(F.array_intersect("_p_chars", "_e_chars")))
        .withColumn(out, value).drop("_p", "_e", "_p_rest", "_e_rest", "_p_chars", "_e_chars", "_common")
    )
