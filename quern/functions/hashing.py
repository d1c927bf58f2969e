"""Identities: SHA-256 over components, each after its length as eight big-endian bytes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def framed(domain: str, *components: Column) -> Column:
    """The identity of components within a domain, in lower-case hex; null if any component is."""
    parts = [F.lit(domain), *(c.cast("string") for c in components)]
    framed_parts = [p for c in parts for p in (F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), F.encode(c, "UTF-8"))]
    return F.sha2(F.concat(*framed_parts), 256)


def framed_id(domain: str, *components: str) -> str:
    """The same for values at hand."""
    return hashlib.sha256(b"".join(len(b).to_bytes(8, "big") + b for b in (c.encode() for c in (domain, *components)))).hexdigest()


def is_id(column: Column) -> Column:
    return column.rlike("^[0-9a-f]{64}$")
