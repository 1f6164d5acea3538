"""Text functions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.normal import nfc


def clean(text: Column, fallback: str, most: int) -> Column:
    """Trimmed, at most so many code points; the fallback for nothing."""
    return F.coalesce(F.nullif(F.substring(F.trim(text), 1, most), F.lit("")), F.lit(fallback))


def lenient_number(text: Column) -> Column:
    """The first signed decimal of a text without currency signs, percent signs, commas and spaces; else 0."""
    bare = F.regexp_replace(text, "[%￥¥,\\s]", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double"), F.lit(0.0))


def header(text: Column) -> Column:
    """A heading as it is compared: lower case, no brackets, spaces and punctuation."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[（）()【】\[\]\s_\-/:：,，.。]", "")


def code(text: Column) -> Column:
    """A code of letters and a number, in upper case and without zeros between them; any other text in upper case."""
    return F.upper(F.regexp_replace(text, "(?i)^([A-Z]+)0+([0-9]+)$", "$1$2"))


#: The white space that is trimmed, beside ASCII's; quotes around a text, and labels before it.
SPACES = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
QUOTES = "\"“”'‘’"
LABELS = "评价|点评|文案|输出|review"


_SPACE_SIGNS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def stripped(text: Column) -> Column:
    """Without white space of any kind around it."""
    return F.trim(text, F.lit(_SPACE_SIGNS))


def strip_noise(text: Column) -> Column:
    """Without code fences, quotes and a label around the whole, and without line breaks."""
    out = F.regexp_replace(F.regexp_replace(stripped(text), "^(?i)```(json|text)?", ""), "```$", "")
    out = F.trim(out, F.lit(QUOTES))
    out = F.regexp_replace(out, f"^(?i)({LABELS})[{SPACES}]*[:：][{SPACES}]*", "")
    return stripped(F.regexp_replace(out, f"[{SPACES}]*\\n[{SPACES}]*", " "))


def length(text: Column) -> Column:
    return F.char_length(F.trim(text))


#: What ends a link, share tokens, signs without width, and control characters.
LINK_END = "\"'<>，。！？、；：）)】\\]"
SHARE = r"(?i)复制所有描述#\*[a-z0-9]{6,}\*#[0-9]?@?.*?(App|应用|后到|打开)?"
SHARE_TOKEN = r"(?i)#\*[a-z0-9]{6,}\*#[0-9]?@?"
WIDTHLESS = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
UNSAFE = (r"(?i)https?://", rf"(?i)(^|[{SPACES}])[a-z][a-z0-9.+-]*://", rf"(?i)复制所有描述|后到|#\*[a-z0-9]{{6,}}\*#|@[^{SPACES}]{{1,20}}")


def sanitize(text: Column) -> Column:
    """Without links, share tokens, signs without width and control characters; white space within a line is one space, lines stay. The text is composed (NFC) first."""
    out = F.regexp_replace(nfc(text), f"(?i)https?://[^{SPACES}{LINK_END}]+", "")
    out = F.regexp_replace(out, f"(?i)(^|[{SPACES}])[0-9a-z][0-9a-z.+-]*://[^{SPACES}{LINK_END}]+", " ")
    out = F.regexp_replace(F.regexp_replace(out, SHARE, ""), SHARE_TOKEN, "")
    out = F.regexp_replace(F.regexp_replace(out, "\u00a0", " "), WIDTHLESS, "")
    inline = SPACES.replace("\\t-\\r", "\\t\\x0B\\x0C")
    return stripped(F.regexp_replace(F.regexp_replace(out, f"[{inline}]+", " "), CONTROLS, ""))


def safe_to_copy(text: Column) -> Column:
    """Whether a text holds anything, and no link, share token or mention."""
    out = stripped(text) != ""
    for pattern in UNSAFE:
        out = out & ~stripped(text).rlike(pattern)
    return F.coalesce(out, F.lit(False))


def tokens(text: Column) -> Column:
    """Parts between commas, semicolons, bars, slashes, line breaks and their wide forms, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, "[,，、;；|/\\r\\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def distinct_tokens(text: Column, most: int = 100, separator: str = ",") -> Column:
    """Distinct tokens in their order, as many from the start as fit joined into so many code points."""
    # No token is empty, so no more than these can fit.
    each = F.slice(F.array_distinct(tokens(text)), 1, most // 2 + 1)
    start = F.struct(F.lit(-1).alias("n"), F.array().cast("array<string>").alias("kept"))

    def more(got: Column, x: Column) -> Column:
        n = got["n"] + 1 + F.char_length(x)
        return F.struct(n.alias("n"), F.when(n <= most, F.concat(got["kept"], F.array(x))).otherwise(got["kept"]).alias("kept"))

    return F.array_join(F.aggregate(each, start, more, lambda got: got["kept"]), separator)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


#: The kinds of files that orders take.
MIME = (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("pdf", "application/pdf"))


def content_type(ext: Column) -> Column:
    out = F
    for e, m in MIME:
        out = out.when(ext == e, m)
    return out.otherwise("application/octet-stream")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_xml(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def file_name(text: Column, fallback: str = "file", most: int = 80) -> Column:
    """A text as a file's name: what file systems refuse becomes a hyphen."""
    bare = F.regexp_replace(F.trim(text), r'[\\/:*?"<>|\s]+', "-")
    return clean(F.regexp_replace(bare, "^-+|-+$", ""), fallback, most)


def split_label(text: Column) -> tuple[Column, Column]:
    """The title, and what stands in brackets at its end, with these."""
    pattern = "^(.+?)([（(][^）)]*[）)])$"
    fits = text.rlike(pattern)
    return F.when(fits, stripped(F.regexp_extract(text, pattern, 1))).otherwise(F.coalesce(text, F.lit(""))), F.when(fits, stripped(F.regexp_extract(text, pattern, 2))).otherwise("")


def byte_size(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    kb, mb = n / F.lit(1024.0), n / F.lit(1048576.0)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def last_digits(text: Column) -> Column:
    """The last two digits of a text, padded by zeros."""
    return F.right(F.lpad(F.regexp_replace(text, "[^0-9]", ""), F.greatest(F.lit(2), F.length(F.regexp_replace(text, "[^0-9]", ""))), F.lit("0")), F.lit(2))


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def base_url(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "/+$", "")


def client_ip(forwarded: Column, real: Column, cdn: Column) -> Column:
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(F.trim(real), F.lit("")), F.nullif(F.trim(cdn), F.lit("")), F.lit("unknown"))


def occurrences(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def column_index(letters: Column) -> Column:
    """The place of a sheet's column, from 0: A, B, ..., Z, AA, ..."""
    digits = F.filter(F.split(F.upper(letters), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def has_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_hits(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """How many of the groups have a word in the text."""
    return sum((has_any(text, g).cast("int") for g in groups), start=F.lit(0))


def quote_csv(text: Column) -> Column:
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
