"""Identities: domain-separated digests of length-framed facts, native ids, wire ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of the wire ids.
PREFIXES = {"source": "src_v1_", "document": "doc_v1_", "session": "ses_v1_", "message": "msg_v1_", "placement": "plc_v1_"}
DIGITS = 32


def derive(kind: str, *facts: Column) -> Column:
    """Prefix and digest of the facts; each is framed by its byte length, so no two lists of facts run together."""
    framed = F.concat(F.lit(PREFIXES[kind]), *[x for f in facts for x in (F.lpad(F.octet_length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), 20, "0"), F.coalesce(f.cast("string"), F.lit("")))])
    return F.concat(F.lit(PREFIXES[kind]), F.left(F.sha2(framed, 256), F.lit(DIGITS)))


def native_ok(c: Column) -> Column:
    """A native id is usable: 1 to 256 characters, no blanks and no control characters."""
    return F.coalesce((F.length(c) >= 1) & (F.length(c) <= 256) & ~c.rlike(r"[\s\p{Cc}]"), F.lit(False))


def message_id(native: Column, provider: Column, variant: Column, document: Column, seq: Column) -> tuple[Column, Column]:
    """(id, stable): the native id where usable, else one derived from the place in the document."""
    ok = native_ok(native)
    return F.when(ok, F.concat(F.lit(PREFIXES["message"]), native)).otherwise(derive("message", provider, variant, document, seq)), ok


def document_id(provider: Column, variant: Column, fingerprint: Column) -> Column:
    return derive("document", provider, variant, fingerprint)


def session_id(provider: Column, namespace: Column, native: Column, document: Column) -> Column:
    """From the native session id within its installation; without one, from the document."""
    return F.when(native_ok(native), derive("session", provider, namespace, native)).otherwise(derive("session", document))


def placement_id(session: Column, document: Column, message: Column, ordinal: Column) -> Column:
    return derive("placement", session, document, message, ordinal)


def wire_kind(c: Column) -> Column:
    """Kind of a wire id, null if the prefix is unknown or nothing follows it."""
    out = F.lit(None).cast("string")
    for kind, p in PREFIXES.items():
        out = F.when(c.startswith(p) & (F.length(c) > len(p)), kind).otherwise(out)
    return out
