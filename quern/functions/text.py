"""Text functions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and what is left without them: by rule, from the characters' decompositions.
_FOLDED = {chr(c): d for c in range(0xC0, 0x250) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}


def without_marks(text: Column) -> Column:
    """text with its Latin letters' diacritics taken off. Spark has no normalisation; this covers U+00C0 to U+024F."""
    return F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values()))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters, without marks."""
    return F.regexp_extract_all(F.lower(without_marks(F.coalesce(text, F.lit("")))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def last_segment(path: Column, separator: str = "/") -> Column:
    return F.substring_index(path, separator, -1)


def parent_path(path: Column) -> Column:
    """The directory; null at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", ""))


def ancestors(path: Column) -> Column:
    """Every prefix of whole segments, the path itself last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def clip_bytes(text: Column, limit: int) -> Column:
    """At most limit bytes, ending with a whole character: an incomplete one at the cut is dropped."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    tail = F.regexp_replace(F.decode(cut, "ISO-8859-1"), r"[À-ÿ][\u0080-¿]*$", "")
    whole = F.decode(F.encode(tail, "ISO-8859-1"), "UTF-8")
    kept = F.when(F.is_valid_utf8(cut.cast("string")), cut.cast("string")).otherwise(whole)
    return F.when(F.octet_length(text) <= limit, text).otherwise(kept)


def mul_scaled(a: Column, b: Column) -> Column:
    """a * b in millionths, rounded half away from zero; overflow is an error in ANSI mode."""
    product = a.cast("long") * b.cast("long")
    shifted = product + F.signum(product).cast("long") * 500_000
    return F.call_function("div", shifted, F.lit(1_000_000).cast("long"))
