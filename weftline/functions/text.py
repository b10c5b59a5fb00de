"""Text analysis shared by indexing and querying, as column expressions (whole-stage codegen, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Han blocks that are split into characters.
HAN_RANGES = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
HAN = f"[{HAN_RANGES}]"
#: Only so many leading characters of a text are indexed.
INDEX_CHARS = 16_000
MAX_TERMS = 8


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def bounded_index_text(c: Column) -> Column:
    return F.left(c, F.lit(INDEX_CHARS))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_phrases(query: str) -> list[list[str]]:
    """A query as phrases: each blank-separated word is the list of its letter-digit runs, which must stand side by side.

    Operators, quotes and wild cards have no meaning; words of punctuation only vanish.
    """
    import re

    out = []
    for w in query.split():
        runs = [x for x in re.findall(r"[^\W_]+", w.lower())]
        if runs:
            out.append(runs)
    return out


def _runs(c: Column) -> Column:
    """Blank-separated words cut into runs of Han and of other characters."""
    return F.flatten(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.regexp_extract_all(w, F.lit(rf"{HAN}+|[^{HAN_RANGES}]+"), F.lit(0))))


def _grams(run: Column, n: int) -> Column:
    count = F.length(run) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def cjk_tokens(c: Column) -> Column:
    """Index form of a text: Han runs become their characters followed by their pairs; without Han it stays as it is."""
    one = F.flatten(F.transform(_runs(c), lambda r: F.when(r.rlike(HAN), F.concat(_grams(r, 1), _grams(r, 2))).otherwise(F.array(r))))
    return F.when(has_han(c), F.array_join(one, " ")).otherwise(c)


def cjk_bigrams(c: Column) -> Column:
    """Evidence form: Han runs become pairs only; a single character stays."""
    one = F.flatten(F.transform(_runs(c), lambda r: F.when(r.rlike(HAN) & (F.length(r) > 1), _grams(r, 2)).otherwise(F.array(r))))
    return F.when(has_han(c), F.array_join(one, " ")).otherwise(c)


def literal_terms(query: Column) -> Column:
    """At most eight distinct terms of the evidence form that hold a letter or digit."""
    return F.slice(F.array_distinct(F.filter(F.split(cjk_bigrams(query), r"\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))), 1, MAX_TERMS)


def why_matched(terms: Column, *haystacks: Column) -> Column:
    """Terms found, ignoring case, in the first of the haystacks that holds any of them."""

    def held(h: Column) -> Column:
        return F.filter(terms, lambda t: F.contains(F.lower(h), F.lower(t)))

    hits = [held(h) for h in haystacks]
    out = F.array().cast("array<string>")
    for h in reversed(hits):
        out = F.when(F.size(F.coalesce(h, F.array().cast("array<string>"))) > 0, h).otherwise(out)
    return out


def snippet(text: Column, terms: Column, width: int) -> Column:
    """Window of ``width`` characters around the earliest term, grown two characters right for each one left."""
    n, m = F.length(text), F.lit(width)
    places = F.filter(F.transform(terms, lambda t: F.struct(F.position(F.lower(t), F.lower(text)).alias("p"), F.length(t).alias("l"))), lambda x: (x["p"] > 0) & (x["l"] > 0))
    first = F.reduce(places, F.struct(F.lit(0).alias("p"), F.lit(0).alias("l")), lambda a, x: F.when((a["p"] == 0) | (x["p"] < a["p"]), F.struct(x["p"].alias("p"), x["l"].alias("l"))).otherwise(a))
    s, e = first["p"] - 1, first["p"] - 1 + first["l"]
    extra = m - first["l"]
    left0 = F.floor(extra / 3).cast("int")
    right0 = extra - left0
    short_right, short_left = n - e < right0, s < left0
    left = F.when(short_right, F.least(s, extra - (n - e))).when(short_left, s).otherwise(left0)
    right = F.when(short_right, n - e).when(short_left, F.least(n - e, extra - s)).otherwise(right0)
    return F.when(first["p"] == 0, F.left(text, m)).when(extra <= 0, F.substring(text, first["p"], m)).otherwise(F.substring(text, s - left + 1, left + first["l"] + right))


def json_len(c: Column) -> Column:
    """Bytes of a string written as JSON: quotes and backslashes take two, control characters six."""
    twice = F.length(F.regexp_replace(c, r'[^"\\]', ""))
    control = F.length(F.regexp_replace(c, r"[^\x00-\x1F\x7F]", ""))
    return F.lit(2) + F.octet_length(c) + twice + control * 5


def token_estimate(c: Column) -> Column:
    """A Han character is one token; of other text four bytes are."""
    rest = F.regexp_replace(c, HAN, "")
    return (F.length(c) - F.length(rest) + F.ceil(F.octet_length(rest) / 4)).cast("bigint")


def hook_text(c: Column, max_tokens: int) -> Column:
    return F.left(c, F.lit(max_tokens * 4))


def shell_quote(c: Column) -> Column:
    """Quoted for a POSIX shell; plain words stay bare."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def safe_token(c: Column) -> Column:
    """The text if it can stand in a command line preview, else null."""
    return F.when(c.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z") & ~c.startswith("-"), c)


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))


def from_base64url(c: Column) -> Column:
    padded = F.concat(F.translate(c, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4)).cast("int")))
    return F.unbase64(padded)


def digest16(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def percent_decode(c: Column) -> Column:
    return F.try_url_decode(c)


def content_text(c: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """Text of a JSON content: a string as it is, the blocks of an array or a single block joined by line breaks."""
    blocks = F.from_json(F.when(c.startswith("["), c).when(c.startswith("{"), F.concat(F.lit("["), c, F.lit("]"))), "array<struct<type:string,text:string,thinking:string>>")
    keep = F.filter(blocks, lambda b: F.coalesce(b["type"], F.lit("text")).isin(*kinds) & (F.coalesce(b["text"], b["thinking"]).isNotNull()))
    return F.when(blocks.isNotNull(), F.array_join(F.transform(keep, lambda b: F.coalesce(b["text"], b["thinking"])), "\n")).otherwise(c)
