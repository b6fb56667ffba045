"""Identity, hashing, safe casts and canonical JSON as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """JSON of an object with sorted keys and no blanks; nulls are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def prefixed_hash(prefix: str, payload: Column) -> Column:
    """prefix and the first 32 hex digits of the SHA-256 of the payload."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 32))


def paragraph_id(source: Column, text: Column, page_start: Column, page_end: Column) -> Column:
    """A content-derived id of a paragraph."""
    text_hash = F.sha2(F.coalesce(text, F.lit("")), 256)
    return prefixed_hash("par_", canonical_json(source=source, page_start=page_start, page_end=page_end, text_sha256=text_hash, segmentation_major=F.lit(2)))


def retrieval_id(parent: Column, start: Column, end: Column, text: Column) -> Column:
    """A content-derived id of a chunk."""
    payload = canonical_json(parent_paragraph_id=parent, parent_char_start=start, parent_char_end=end, indexed_text_sha256=F.sha2(text, 256))
    return prefixed_hash("ret_", payload)


def article_id(source: Column, title: Column, start: Column, end: Column) -> Column:
    """Hash over the identity of an article, its parts separated by U+001F."""
    return prefixed_hash("art_", F.concat_ws("\u001f", source, title, start.cast("string"), end.cast("string")))


def explicit_or_hashed(value: Column, payload: Column, prefix: str = "mr2_") -> Column:
    """The given id if it is not blank, else a hash of the position."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), prefixed_hash(prefix, payload))


def to_int(x: Column) -> Column:
    """An integer, or null where the text is none."""
    return x.try_cast("int")


def day_of(epoch_seconds: Column) -> Column:
    """The date of an epoch second in the session's time zone."""
    return F.to_date(F.timestamp_seconds(epoch_seconds))
