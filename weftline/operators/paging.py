"""Response budgets, cost model and opaque cursors (driver side)."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import json_len

CONTRACT = "v1"
TTL = timedelta(minutes=15)
WINDOW, GROUP_FACTOR, WINDOW_CAP = 512, 16, 1 << 20
RESERVED = 1024


@dataclass(frozen=True)
class Budget:
    """Defaults of a response; bytes have a floor."""

    max_bytes: int = 4 << 20
    max_items: int = 1000
    snippet_chars: int = 2000
    max_messages: int = 500
    max_spans: int = 1000

    def __post_init__(self) -> None:
        if self.max_bytes < 4096 or min(self.max_items, self.snippet_chars, self.max_messages, self.max_spans) < 1:
            raise ValueError("a budget lies below its floor")


def hit_cost(id_: Column, session: Column, text: Column, why: Column, suggestions: Column, occurrences: Column) -> Column:
    """Bytes a hit takes in a response."""

    def lens(a: Column, more: int) -> Column:
        n = F.size(F.coalesce(a, F.array().cast("array<string>")))
        s = F.reduce(F.coalesce(a, F.array().cast("array<string>")), F.lit(0), lambda x, y: x + json_len(y).cast("int"))
        return F.when(n > 0, s + n + more).otherwise(0)

    occ = F.when(occurrences > 1, F.length(occurrences.cast("string")) + 14).otherwise(0)
    return json_len(id_) + 14 + F.coalesce(json_len(session), F.lit(4)) + 8 + F.coalesce(json_len(text), F.lit(4)) + lens(why, 15) + lens(suggestions, 27) + occ + 24 + 32


def list_cost(id_: Column, payload: Column, peek: Column, title: Column) -> Column:
    return json_len(id_) + json_len(payload) + 18 + F.coalesce(json_len(peek) + 8, F.lit(0)) + F.coalesce(json_len(title) + 9, F.lit(0))


def rank_window(lexical_like: bool, grouped: bool, offset: int, page: int) -> int:
    """Rows that are ranked: a fixed window, so pages do not depend on the offset; pure vector search needs just its page."""
    n = WINDOW if lexical_like or grouped else offset + page + 1
    return min(n * (GROUP_FACTOR if grouped else 1), WINDOW_CAP)


def query_digest(**inputs) -> str:
    """Digest of everything that changes results or their order."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()


def _digest16(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def make_cursor(offset: int, digest: str, generation: int, sort: str, now: datetime, expires: datetime | None = None) -> str:
    claims = {"contract": CONTRACT, "offset": offset, "digest": digest, "generation": generation, "sort": sort, "clock": now.isoformat(), "expires": (expires or now + TTL).isoformat()}
    body = base64.urlsafe_b64encode(json.dumps(claims, sort_keys=True).encode()).decode().rstrip("=")
    return f"{body}.{_digest16(body)}"


class CursorError(ValueError):
    """The cursor can't be used: malformed, tampered, of another contract, expired, stale or of another query."""


def read_cursor(token: str, digest: str, generation: int, sort: str, now: datetime) -> dict:
    """Claims of a cursor; checks come in a fixed order. The first page's clock and expiry go on."""
    body, dot, seal = token.partition(".")
    if not dot or not body:
        raise CursorError("malformed")
    if seal != _digest16(body):
        raise CursorError("tampered")
    claims = json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    for ok, why in ((claims["contract"] == CONTRACT, "contract"), (now < datetime.fromisoformat(claims["expires"]), "expired"), (claims["generation"] == generation, "generation"), (claims["digest"] == digest, "query"), (claims["sort"] == sort, "sort")):
        if not ok:
            raise CursorError(why)
    return claims
