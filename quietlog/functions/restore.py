"""Restore redacted text, and the token form of a replacement list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog.functions import rules as R
from quietlog.functions.text import let, trim_space
from quietlog.schemas import REPLACEMENTS

# The HTML escapes of a restored value.
HTML_ESCAPES = (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"))


def html_escape(c: Column) -> Column:
    for raw, escaped in HTML_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def restore(text: Column, replacements: Column, escape_html: bool = False) -> Column:
    """Replace each placeholder by the next original of its tag; a tag without originals left stays.

    The n-th placeholder of a tag takes the n-th original of that tag.  Both sides are numbered by
    sorting on (tag, position), so the work is n log n in the row, however many placeholders it has.
    """
    tags = F.regexp_extract_all(text, F.lit(R.PLACEHOLDER), F.lit(0))
    gaps = F.split(text, R.PLACEHOLDER, -1)
    shown = (lambda o: html_escape(o)) if escape_html else (lambda o: o)

    def queue(t):
        return F.transform(F.filter(replacements, lambda r: r.tag == t), lambda r: r.original)

    def fill(found):
        # distinct tags are few (one per rule), so one queue and one start offset for each
        kinds = F.array_sort(F.array_distinct(found))
        ordered = F.array_sort(F.transform(found, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
        state = F.struct(
            ordered.alias("ordered"),
            F.map_from_arrays(kinds, F.transform(kinds, queue)).alias("queues"),
            F.map_from_arrays(
                kinds, F.transform(kinds, lambda k: F.array_position(F.array_sort(found), k).cast("int") - 1)
            ).alias("starts"),
        )

        def numbered(s):
            def one(x, j):
                original = F.get(F.element_at(s.queues, x.t), j - F.element_at(s.starts, x.t))
                return F.struct(x.i.alias("i"), F.coalesce(shown(original), x.t).alias("v"))

            return F.transform(F.array_sort(F.transform(s.ordered, one)), lambda x: x.v)

        filled = let(state, numbered)
        return F.array_join(F.zip_with(gaps, filled, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")

    return F.when(~text.rlike(R.PLACEHOLDER), text).otherwise(let(tags, fill))


def mapping_replacements(mapping: Column) -> Column:
    """Replacements of a bare mapping, in the order of the originals (a map has no order of its own)."""
    entries = F.array_sort(F.map_entries(mapping))
    return F.transform(entries, lambda e: F.struct(e.key.alias("original"), e.value.alias("tag")))


def encode_token(replacements: Column, mapping: Column | None = None) -> Column:
    """Versioned JSON in unpadded URL-safe base64; with the mapping, where one is given."""
    both = [replacements.alias("replacements"), F.lit(1).alias("v")]
    body = F.to_json(F.struct(*([] if mapping is None else [mapping.alias("mapping")]), *both))
    # base64 breaks no lines here only because the breaks are taken out again
    plain = F.regexp_replace(F.base64(body.cast("binary")), "[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def decode_token(token: Column) -> Column:
    """struct<replacements, mapping> of a token; null if it is not one."""
    t = F.translate(trim_space(token), "-_", "+/")
    padded = F.rpad(t, F.length(t) + (4 - F.length(t) % 4) % 4, "=")
    raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.from_json(raw, f"replacements {REPLACEMENTS}, mapping map<string,string>")
