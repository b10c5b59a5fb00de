"""Secrets out of texts: whole-value shapes, shapes inside prose, and secret-named members of JSON trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[REDACTED]"
_L, _T = r"(?<![A-Za-z0-9_-])", r"[A-Za-z0-9_+/=-]"
#: Prefixes of credentials with the least number of characters that follow; the order matters.
PREFIXES = (("AKIA", 16), ("github_pat_", 9), ("gh[posur]_", 36), ("xox[bpae]-", 15), ("AIza", 35), ("[sr]k_(?:live|test)_", 12), ("glpat-", 20), ("sk-ant-", 13), ("sk-", 17), ("xai-", 16))
_BEARER = rf"{_L}(Bearer ){_T}{{4,}}"
_AWS = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
_JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*"
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
SECRET_KEYS = re.compile(r"(?:^|[_-])(?:password|passwd|secret|token|api_?key|apikey|auth(?:orization)?|credential|private_?key|access_?key)s?$", re.I)
EXEMPT_KEYS = re.compile(r"(?:input|output|cache|reasoning|total|max)_?.*tokens?$|tokens?_(?:used|count|source)$|public_?key", re.I)
LEAST_BYTES = 8


def standalone(c: Column) -> Column:
    """True for a value that is as a whole a credential."""
    whole = [_JWT + r"\z", _PEM, r"[A-Za-z0-9+/]{40}\z", r"Bearer \S+\z"] + [rf"{p}{_T}{{{n},}}\z" for p, n in PREFIXES]
    out = F.lit(False)
    for p in whole:
        out = out | c.rlike(r"\A" + p)
    return (F.octet_length(c) >= LEAST_BYTES) & out


def embedded(c: Column) -> Column:
    """The text with every credential inside it replaced; texts under eight bytes stay."""
    out = c
    for p, n in PREFIXES:
        out = F.regexp_replace(out, rf"{_L}{p}{_T}{{{n},}}", MARK)
    out = F.regexp_replace(out, _BEARER, "$1" + MARK)
    out = F.regexp_replace(out, _AWS, MARK)
    out = F.regexp_replace(out, _JWT, MARK)
    return F.when(F.octet_length(c) >= LEAST_BYTES, out).otherwise(c)


def embedded_count(c: Column) -> Column:
    """Number of replacements ``embedded`` makes."""
    return ((F.length(F.regexp_replace(embedded(c), re.escape(MARK), MARK + "\u0001")) - F.length(embedded(c))) - (F.length(F.regexp_replace(c, re.escape(MARK), MARK + "\u0001")) - F.length(c))).cast("int")


def _walk(x, key: str | None, hits: list[int]):
    if isinstance(x, dict):
        return {k: _walk(v, k, hits) for k, v in x.items()}
    if isinstance(x, list):
        return [_walk(v, key, hits) for v in x]
    if isinstance(x, str) and key and x and SECRET_KEYS.search(key) and not EXEMPT_KEYS.search(key):
        hits[0] += 1
        return MARK
    return x


def json_tree(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """(id, json, n_blanked): strings under secret-named members are blanked; numbers and flags stay. Texts that are no
    JSON come back as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, n = [], []
            for t in f["j"]:
                hits = [0]
                try:
                    t = json.dumps(_walk(json.loads(t), None, hits), ensure_ascii=False, separators=(",", ":")) if t is not None else None
                except ValueError:
                    pass
                out.append(t)
                n.append(hits[0])
            yield pd.DataFrame({"id": f["id"], "json": out, "n_blanked": n})

    return df.select(F.col(id_col).alias("id"), F.col(json_col).alias("j")).mapInPandas(run, f"id {dict(df.dtypes)[id_col]}, json string, n_blanked int")


def status(df: DataFrame, text_col: str, mode: str = "machine") -> DataFrame:
    """One row {mode, status, ruleset, count}: machine outputs are redacted, local human ones are not."""
    n = F.sum(embedded_count(F.col(text_col))) if mode == "machine" else F.lit(0).cast("bigint")
    return df.agg(F.coalesce(n, F.lit(0)).alias("count")).select(F.lit(mode).alias("mode"), F.lit("applied" if mode == "machine" else "off").alias("status"), F.lit("v1.1").alias("ruleset"), "count")
