"""Text cleaning, whitespace and sizes as Column expressions."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from optrace import constants as K

# Every character Python's str.strip() and str.split() treat as blank; Java's \\s is narrower.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Printable ASCII, nearly all of most texts, is told by one range before the characters are tried one by one.
BLANK = f"[[^!-~]&&[{BLANK_CHARS}]]"
# Every line boundary Python's str.splitlines() knows.
LINE_BREAK = r"\R|[\x1c-\x1e]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def strip_right(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANK_CHARS))


def printable_at(c: Column, at: int) -> Column:
    """Is the first (1) or last (-1) byte a printable one of ASCII, other than the space?"""
    byte = F.substring(c.cast("binary"), at, 1)
    return (byte >= F.lit(b"!")) & (byte <= F.lit(b"~"))


# A trim from the right walks over a whole text, but mostly takes away a little of its end.
TAIL_BYTES, KEPT_BYTES = 64, 16


def first_bytes(c: Column, n: Column) -> Column:
    """The first n bytes of a text, without a walk over its characters; n is where a character ends."""
    return F.substring(c.cast("binary"), F.lit(1), n).cast("string")


def from_byte(c: Column, at: Column) -> Column:
    """What follows the first at bytes of a text."""
    return F.substring(c.cast("binary"), at + 1, F.octet_length(c)).cast("string")


def cut_right(c: Column, cut: Callable[[Column], Column]) -> Column:
    """cut(c), for a plain column and a cut that only takes blanks and marks of less than KEPT_BYTES off the end. It
    looks at the last bytes; only if it leaves few of them, the whole text counts."""
    tail = F.substring(c.cast("binary"), F.lit(-TAIL_BYTES), F.lit(TAIL_BYTES)).cast("string")
    kept = cut(tail)
    short = first_bytes(c, F.octet_length(c) - F.octet_length(tail) + F.octet_length(kept))
    return F.when(F.octet_length(kept) >= KEPT_BYTES, short).otherwise(cut(c))


def strip_plain(c: Column) -> Column:
    """As strip, for a plain column (it is named several times): most texts begin and end with a printable character."""
    right = strip_right_plain(c)
    return F.when(printable_at(c, 1), right).otherwise(F.ltrim(right, F.lit(BLANK_CHARS)))


def strip_right_plain(c: Column) -> Column:
    """As strip_right, for a plain column."""
    return F.when(printable_at(c, -1), c).otherwise(cut_right(c, strip_right))


def fold_blanks(c: Column, stripped: Column | None = None) -> Column:
    """Outer blanks removed, inner runs reduced to one space; the text without outer blanks may be at hand."""
    # Single spaces, nearly all blanks, are no match: they are what they become. Neither they nor printable characters
    # are looked up among all the blanks.
    return F.regexp_replace(strip(c) if stripped is None else stripped, rf" {BLANK}+|[[^ -~]&&{BLANK}]{BLANK}*", " ")


def lines(c: Column) -> Column:
    """Split at every line boundary; a final boundary opens no further line."""
    return F.split(F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, -1)


def sanitize_text(c: Column) -> Column:
    """Drop control characters other than tab, line feed and carriage return; NULL gives ''."""
    return F.coalesce(F.regexp_replace(c, CONTROL, ""), F.lit(""))


def sanitize_tree(c: Column) -> Column:
    return strip(sanitize_text(c))


def sanitize_read(c: Column) -> Column:
    """As sanitize_text: outer whitespace belongs to the file and stays."""
    return sanitize_text(c)


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.char_length(c) / K.CHARS_PER_TOKEN)


def truncate_at_newline(c: Column, n: int) -> Column:
    """First n characters, cut back to the last line feed when that lies beyond 70 % of n."""
    head = F.substring(c, 1, n)
    newline = F.char_length(head) - F.locate("\n", F.reverse(head))
    has_newline = F.locate("\n", head) > 0
    cut = F.when(has_newline & (newline > n * 0.7), F.left(head, newline)).otherwise(head)
    return F.when(F.char_length(c) > n, cut).otherwise(c)


def write_preview(data: Column) -> Column:
    """struct(data, data_length): text of written bytes, cut with a mark, and their number."""
    text = F.make_valid_utf8(data.cast("string"))
    short = F.when(
        F.char_length(text) > K.WRITE_PREVIEW_CHARS,
        F.concat(F.left(text, F.lit(K.WRITE_PREVIEW_CHARS)), F.lit(K.WRITE_PREVIEW_MARK)),
    ).otherwise(text)
    return F.struct(short.alias("data"), F.octet_length(data).cast("long").alias("data_length"))


def format_size(c: Column) -> Column:
    """Bytes as '0 B', '17 B', '1.50 KB', ...; NULL gives ''."""

    def scaled(unit: int, label: str) -> Column:
        return F.format_string(f"%.2f {label}", F.bround(c / F.lit(float(unit)), 2))

    return (
        F.when(c.isNull(), "")
        .when(c == 0, "0 B")
        .when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024**2, scaled(1024, "KB"))
        .when(c < 1024**3, scaled(1024**2, "MB"))
        .otherwise(scaled(1024**3, "GB"))
    )


def mode_to_octal(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 8))


def octal_to_mode(c: Column) -> Column:
    """Permission bits of octal text, with or without a 0o mark and file-type bits."""
    return F.conv(F.regexp_replace(c, "^0o", ""), 8, 10).cast("int").bitwiseAND(F.lit(0o7777))


def canonical_mtime(is_dir: Column) -> Column:
    return F.when(is_dir, K.DIR_MTIME_TEXT).otherwise(K.FILE_MTIME_TEXT)


def parse_mtime(c: Column, default: Column) -> Column:
    """ISO text to epoch seconds; missing or malformed text gives the caller's default."""
    looks_iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    stamp = F.when(looks_iso, F.try_to_timestamp(c))
    return F.coalesce(F.unix_micros(stamp) / F.lit(1e6), default)


def python_float(c: Column) -> Column:
    """A double in the plain notation of a JSON writer (1698400800.0, not 1.6984008E9)."""
    plain = c.cast("string").cast("decimal(38,12)").cast("string")
    trimmed = F.regexp_replace(plain, "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def json_string(c: Column) -> Column:
    """One JSON string literal in ASCII."""
    boxed = F.to_json(F.array(c))
    return escaped_json(F.substring(boxed, F.lit(2), F.char_length(boxed) - 2))


def escaped_json(c: Column) -> Column:
    """JSON text with everything beyond ASCII as \\u escapes, surrogate pairs included."""
    beyond = r"[^\x00-\x7e]"

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def shown(ch: Column) -> Column:
        code = F.ascii(ch)
        rest = code - 0x10000
        pair = F.concat(unit(F.floor(rest / 1024) + 0xD800), unit(rest % 1024 + 0xDC00))
        return F.when(~ch.rlike(beyond), ch).when(code < 0x10000, unit(code)).otherwise(pair)

    spelled = F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), 0), shown), "")
    return F.when(c.rlike(beyond), spelled).otherwise(c)


def python_repr(c: Column) -> Column:
    """Quoted form of a string: single quotes unless only those occur inside, escapes for
    the backslash, the quote and everything unprintable."""
    escaped = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    unprintable = r"[\p{C}\p{Z}&&[^ ]]"

    def shown_char(ch: Column) -> Column:
        code = F.ascii(ch)
        digits = F.lower(F.hex(code))
        return (
            F.when(~ch.rlike(unprintable), ch)
            .when(code < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(code < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    escaped = F.when(
        escaped.rlike(unprintable), F.array_join(F.transform(F.split(escaped, ""), shown_char), "")
    ).otherwise(escaped)
    double = c.contains("'") & ~c.contains('"')
    single_quoted = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single_quoted)


def extract_result(c: Column) -> Column:
    """Text between <result> tags if any, stripped and without a final stop token."""
    tagged = r"(?s)<result>(.*?)</result>"
    body = strip(F.when(c.rlike(tagged), F.regexp_extract(c, tagged, 1)).otherwise(c))
    without = F.left(body, F.char_length(body) - len(K.STOP_TOKEN))
    return F.when(body.endswith(K.STOP_TOKEN), strip(without)).otherwise(body)


def extract_result_lines(c: Column) -> Column:
    """Older unwrapping: per line, blank lines dropped, an answer prefix cut at its colon."""

    def unwrap(line: Column) -> Column:
        lowered = F.lower(line)
        starts = F.lit(False)
        for prefix in K.LEGACY_ANSWER_PREFIXES:
            starts = starts | lowered.startswith(prefix)
        colon = F.locate(":", line)
        after = F.when(colon > 0, F.substring(line, colon + 1, F.char_length(line))).otherwise(line)
        return F.when(starts, strip(after)).otherwise(line)

    kept = F.filter(F.transform(F.split(c, "\n", -1), strip), lambda line: line != "")
    return strip(F.array_join(F.transform(kept, unwrap), "\n"))
