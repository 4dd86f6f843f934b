"""Text helpers shared by grading, redaction and token counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points the reference semantics treat as white space when trimming.
SPACE_CHARS = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028"
    "\u2029\u202f\u205f\u3000"
)
# The 25 invisible code points dropped before redaction.
INVISIBLE = (
    "\u200b\u200c\u200d\u200e\u200f\xad\u034f\u061c\u180e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068"
    "\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
)
# ASCII plus letters that NFKC never changes or combines: such text needs no normalisation.
STABLE = (
    r"^(?:[\x00-\x7F]++|[À-ıĴ-ľŁ-ňŊ-ž]++|[Α-ΡΣ-ώ]++"
    r"|[Ё-ҁ]++|[‐–-‖‘-‟、-〃々-〇]++"
    r"|[ぁ-ゔァ-ヺ]++|[一-鿿]++|[가-힣]++)*+\z"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body mentions it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def pin(c: Column) -> Column:
    """The same value, but never folded into the expressions that use it.

    The optimizer merges a projection with the Arrow-backed one above it and then evaluates a costly
    column once per use; it leaves non-deterministic expressions where they are.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trim_space(c) == "", F.lit(True))


def byte_prefix(c: Column, n: int) -> Column:
    """First n bytes; a character cut in half decodes as U+FFFD."""
    return F.decode(F.substring(c.cast("binary"), 1, n), "UTF-8")


def contains_any(c: Column, literals) -> Column:
    out = F.lit(False)
    for i, lit in enumerate(literals):
        out = c.contains(lit) if i == 0 else out | c.contains(lit)
    return out


def needs_normalizing(c: Column) -> Column:
    """True when unescaping, percent-decoding or NFKC could change the text."""
    plain_bytes = F.octet_length(c) == F.char_length(c)
    return (c.contains("&") & c.rlike("&[#A-Za-z]")) | (c.contains("%") & c.rlike("%[0-9A-Fa-f]{2}")) | (~plain_bytes & ~c.rlike(STABLE))


#: bytes of Arrow data that a Python function takes apart at a time; bounds a worker's memory
STEP_BYTES = 1 << 18


def in_steps(one, kind, *columns):
    """`one` (lists of values to a list of results) over rows of Arrow columns, some at a time; results as an array of `kind`."""
    import pyarrow as pa

    todo, done = [(0, len(columns[0]))], []
    while todo:
        start, n = todo.pop()
        parts = [c.slice(start, n) for c in columns]
        if n > 1 and sum(p.nbytes for p in parts) > STEP_BYTES:
            todo += [(start + n // 2, n - n // 2), (start, n // 2)]
        else:
            done.append(pa.array(one(*(p.to_pylist() for p in parts)), kind))
    out = pa.concat_arrays(done) if len(done) > 1 else done[0]
    del done
    pa.default_memory_pool().release_unused()
    return out


def clean_text(text: str) -> str:
    import codecs
    import html
    import re
    import unicodedata
    from urllib.parse import unquote_to_bytes

    # one U+FFFD for every byte that is not UTF-8
    codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))
    if "&" in text:
        # html.unescape drops invalid numeric references; keep the code point they name
        def numeric(m):
            body = m.group(1)
            n = int(body[1:], 16) if body[0] in "xX" else int(body)
            keep = n < 0x80 and n not in (0, 0x0D) or 0xFDD0 <= n <= 0xFDEF or (n & 0xFFFE == 0xFFFE and n <= 0x10FFFF)
            return chr(n) if keep and html.unescape(m.group(0)) == "" else m.group(0)

        text = html.unescape(re.sub(r"&#([xX][0-9a-fA-F]+|[0-9]+);?", numeric, text))
    if "%" in text and not re.search(r"%(?![0-9A-Fa-f]{2})", text):
        text = unquote_to_bytes(text.encode()).decode("utf-8", "each_byte")
    text = unicodedata.normalize("NFKC", text)
    return text.translate(dict.fromkeys(map(ord, INVISIBLE)))


@F.arrow_udf(T.StringType())
def _normalize_batch(texts):
    import pyarrow as pa

    return in_steps(lambda some: [None if t is None else clean_text(t) for t in some], pa.string(), texts)


@F.arrow_udf(T.StringType())
def nfkc_batch(texts):
    import unicodedata

    import pyarrow as pa

    return in_steps(lambda some: [None if t is None else unicodedata.normalize("NFKC", t) for t in some], pa.string(), texts)


def normalize(c: Column) -> Column:
    """HTML-unescape, percent-decode, NFKC, drop invisible characters.

    Spark has no NFKC, so an Arrow function does the work; rows that cannot change send it only a null.
    """
    need = needs_normalizing(c)
    return F.coalesce(_normalize_batch(F.when(need, c)), c)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _normalize_lists(lists):
    import pyarrow as pa

    return in_steps(lambda some: [None if x is None else [None if t is None else clean_text(t) for t in x] for x in some], pa.list_(pa.string()), lists)


def normalize_each(texts: Column) -> Column:
    """`normalize` for the texts of an array; rows without a text that can change send only a null."""
    sent = F.transform(texts, lambda t: F.when(needs_normalizing(t), t))
    new = _normalize_lists(F.when(F.exists(sent, lambda t: t.isNotNull()), sent))
    return F.when(new.isNull(), texts).otherwise(F.zip_with(texts, new, lambda t, n: F.coalesce(n, t)))
