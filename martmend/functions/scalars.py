"""Native expressions for keys, fingerprints, pseudonyms and texts. No UDFs."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def truthy(c: Column) -> Column:
    """true, 1, t, yes in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "t", "yes"), F.lit(False))


def normalize_key(c: Column) -> Column:
    """Canonical text of an id: +7, 007 and 7.0 are 7; -0 is 0; other texts are only trimmed. Ids of any length."""
    text = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    whole = F.regexp_replace(text, r"^([+-]?[0-9]+)\.0+$", "$1")
    bare = F.regexp_replace(F.regexp_replace(whole, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    return F.when(bare.rlike(r"^-?[0-9]+$"), F.when(bare == "-0", "0").otherwise(bare)).otherwise(text)


def entity_type(key: Column, mart_key: str, entity: str) -> Column:
    """The mart's entity for its own key, x for x_id, else the key's name."""
    name = F.trim(key)
    return F.when(name == mart_key, F.lit(entity)).otherwise(F.regexp_replace(name, r"^(.+)_id$", "$1"))


def pseudonymize(value: Column, secret: str, project: str, entity: str, key: str) -> Column:
    """Keyed SHA-256 (HMAC) of version, project, entity, key and canonical value; an error if a part holds the separator."""
    parts = ["v1", project.strip(), entity.strip().lower(), key.strip().lower()]
    if any("|" in p for p in parts):
        raise ValueError("a component of an entity hash holds '|'")
    raw = secret.encode()
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    canonical = normalize_key(value)
    safe = F.when(F.contains(canonical, F.lit("|")), F.raise_error(F.lit("an entity value holds '|'")).cast("string")).otherwise(canonical)
    message = F.encode(F.concat(F.lit("|".join(parts) + "|"), safe), "utf-8")
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message), 256))
    return F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, null as the empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def event_fingerprint(stream: Column, row_id: Column, operation: Column, pk_before: Column, pk_after: Column, key_before: Column, key_after: Column) -> Column:
    return joined_hash(stream, row_id, operation, pk_before, pk_after, key_before, key_after)


def event_id(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 32)


def relation_fingerprint(model: Column, stream: Column, inserts: Column, updates: Column, deletes: Column) -> Column:
    return joined_hash(model, stream, inserts, updates, deletes)


def direct_reason(entity: str) -> Column:
    return F.lit(f"Direct {entity} key")


def routed_reason(change_key: str, value: Column, entity: str, show_ids: bool = True) -> Column:
    """``Order 1 belongs to customer``; without ids, ``Order belongs to customer``."""
    label = F.initcap(F.translate(F.regexp_replace(F.lit(change_key), "_id$", ""), "_", " "))
    middle = F.concat(F.lit(" "), value.cast("string")) if show_ids else F.lit("")
    return F.concat(label, middle, F.lit(f" belongs to {entity}"))


def before_image_reason(entity: str) -> Column:
    return F.lit(f"Before-image supplied {entity}")


def iso_utc(c: Column) -> Column:
    """ISO text of a timestamp in UTC, with a Z; microseconds only where there are any."""
    utc = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(utc, "SSSSSS") != "000000", F.date_format(utc, ".SSSSSS")).otherwise(""), F.lit("Z"))


#: A quoted text, a comment, or the text up to the next of these.
_PIECE = r"(?s)'(?:[^']|'')*+(?:'|$)|\"(?:[^\"]|\"\")*+(?:\"|$)|--[^\n\r]*+|/\*.*?(?:\*/|$)|(?:[^'\"/-]|-(?!-)|/(?!\*))++"


def plain_text(c: Column) -> Column:
    """A definition without comments, in lower case and with single blanks outside quotes."""
    pieces = F.transform(
        F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0)),
        lambda p: F.when(p.rlike("^(?:--|/\\*)"), F.lit(" ")).when(p.rlike("^['\"]"), p).otherwise(F.lower(p)),
    )
    return F.trim(F.regexp_replace(F.array_join(pieces, ""), r"\s+", " "))


def text_fingerprint(c: Column) -> Column:
    return F.sha2(plain_text(c), 256)
