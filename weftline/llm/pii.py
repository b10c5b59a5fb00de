"""Problem 7: personal data in free text, found by a linear-chain CRF and replaced by typed placeholders.

Tokens are words, digit groups, single Chinese characters and single marks. Features are word shapes, affixes,
neighbouring words and shapes, and the shape of the number or mail-like run a token lies in; digits count by their
number only. The field is trained from :func:`pii_labels.labelled_table` (bounded by its ``per_pattern``
parameter, a few thousand sentences) on the driver in seconds and sent to the tasks as a few MB of weights, a
size set by the labelled table and not by the data. Texts are read whole: they are cut at line and sentence ends,
sentences that differ only in digits are decoded once per task, and Viterbi runs over padded numpy batches.
An exact check follows: a span must have the makings of its kind (a phone number 7 to 15 digits, and so on).

Defined results: null, empty and blank texts give nothing; each surface counts once per row and kind; repeated
rows give their findings each; other columns are ignored. ``redact`` keeps every row and all other text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.crf import Crf
from weftline.llm.pii_labels import LEXICON, Part, labelled_table
from weftline.session import spread

KINDS = ("email", "phone", "id_number", "address", "person")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
TOKEN = re.compile(rf"[{HAN}]|[^\W\d_{HAN}]+|\d+|[^\w\s]|_")
BREAK = re.compile(r"\n|(?<=[a-z]{4}[.?!]) (?=[A-Z])|(?<=[。？！])")
RUN = re.compile(r"[+(]?\d[\d ().\-/]*\d|\d")
MAILISH = re.compile(r"[^\s<>\"';,=()]*[\w.+\-](?:[@＠]|\(at\)|\[at\])[\w\-]+(?:(?:\.|\[dot\]|\(dot\))[\w\-]+)+|[\w.+\-]+ (?:at|\[at\]|\(at\)) [\w\-]+(?:(?:\.| dot | \[dot\] | \(dot\) )[\w\-]+)+", re.I)
NINE = str.maketrans("012345678" + "０１２３４５６７８９", "9" * 19)
_ASCII_NINE = bytes.maketrans(b"012345678", b"999999999")
#: A number of streets, not a street with its number.
COUNTED = re.compile(r"\d+ (?:Street|St|Road|Rd|Lane|Ln|Court|Ct|Close|Avenue|Ave|Drive|Dr|Way|Place|Square)\.?(?: [a-z]+)*")
WINDOW = (-3, -2, -1, 0, 1, 2, 3)
#: Places from which a token's entry in the lexicon is seen.
LISTED = (-2, -1, 0, 1)


def shape(w: str) -> str:
    if w[0].isdigit():
        return "9" * min(len(w), 12)
    if w[0].isalpha():
        if "㐀" <= w[0]:
            return "H"
        if w.isupper():
            return "A" if len(w) == 1 else "AA" if len(w) == 2 else "AAA"
        return "Aa" if w[0].isupper() and w[1:].islower() else "a" if len(w) == 1 else "aa" if w.islower() else "aA"
    return w


class Features:
    """Numbers for the features of token sequences. While ``open`` it learns new features; later unknown ones are 0."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.open = True
        self.words: dict[str, int] = {}
        self.table: list[list[int]] = []
        self.pairs: dict[str, np.ndarray] = {}
        self.run_ids: dict[str, int] = {"": 0}
        self.run_rows: list[tuple[int, ...]] = [(0, 0, 0, 0, 0)]
        self.shapes: list[int] = []
        self.shape_of: dict[str, int] = {}

    def forget(self) -> None:
        """Drop what was derived for words and runs met so far; the numbers of features stay."""
        self.words, self.table, self.shapes, self.pairs = {}, [], [], {}
        self.run_ids, self.run_rows = {"": 0}, [(0, 0, 0, 0, 0)]

    def f(self, name: str) -> int:
        got = self.index.get(name)
        if got is None:
            if not self.open:
                return 0
            got = self.index[name] = len(self.index)
        return got

    def word(self, w: str) -> int:
        """Row of the token table: feature numbers of a token seen from each place of the window."""
        got = self.words.get(w)
        if got is None:
            low, sh = w.lower(), shape(w) if w.strip() else w
            row = [self.f(f"w{o}={low}") for o in WINDOW] + [self.f(f"s{o}={sh}") for o in WINDOW]
            alpha = len(low) > 3 and low[0].isalpha()
            row += [self.f(f"x2={low[-2:]}") if alpha else 0, self.f(f"x3={low[-3:]}") if alpha else 0, self.f(f"p3={low[:3]}") if alpha else 0, self.f(f"x-1={low[-3:]}") if alpha else 0, self.f(f"x+1={low[-3:]}") if alpha else 0]
            listed = LEXICON.get(low)
            row += [self.f(f"z{o}={listed}") if listed else 0 for o in LISTED]
            got = self.words[w] = len(self.table)
            self.table.append(row)
            if not self.open and sh not in self.shape_of:
                sh = "\u0003"  # a mark never seen in training
            self.shapes.append(self.shape_of.setdefault(sh, len(self.shape_of)))
        return got

    def run(self, x: str) -> int:
        """Row of the run table: feature numbers of a number-like or mail-like run."""
        got = self.run_ids.get(x)
        if got is None:
            got = self.run_ids[x] = len(self.run_rows)
            self.run_rows.append((*self._run(x), self.f(f"r-1={x[:24]}"), self.f(f"r+1={x[:24]}")))
        return got

    def pair(self, name: str, a: np.ndarray, b: np.ndarray, sp: np.ndarray) -> np.ndarray:
        """Feature numbers of neighbouring shapes, looked up in a table over all pairs of shapes."""
        n = len(self.shape_of)
        tab = self.pairs.get(name)
        if tab is None or len(tab) != n * n * 2:
            tab = self.pairs[name] = np.full(n * n * 2, -1, np.int32)
        code = (a * n + b) * 2 + sp
        out = tab[code]
        if (out < 0).any():
            by = list(self.shape_of)
            for u in np.unique(code[out < 0]):
                tab[u] = self.f(f"{name}{by[u // 2 // n]}|{by[u // 2 % n]}{u % 2}")
            out = tab[code]
        return out

    def matrix(self, sents: list[tuple[list[str], list[bool], list[str]]], blank: np.random.Generator | None = None) -> np.ndarray:
        """Feature matrix of sentences (words, space-before, run) laid end to end. ``blank``: hide words at random."""
        edge = self.word("\u0002")
        pad = len(WINDOW) // 2
        ids, keep, spaced, runs = [], [], [], []
        for words, space, run in sents:
            ids += [edge] * pad
            keep += [False] * pad
            spaced += [0] * pad
            runs += [0] * pad
            ids += [self.word(w) for w in words]
            keep += [True] * len(words)
            spaced += space
            runs += [self.run(x) if x else 0 for x in run]
        ids += [edge] * pad
        keep += [False] * pad
        spaced += [0] * pad
        runs += [0] * pad
        ids, keep = np.array(ids), np.array(keep)
        table, shp = np.array(self.table, np.int32), np.array(self.shapes)
        at = np.flatnonzero(keep)
        n = len(WINDOW)
        cols = []
        for j, o in enumerate(WINDOW):
            col = table[ids[at + o], j]
            if blank is not None:
                col = np.where(blank.random(len(col)) < (0.35 if o == 0 else 0.2), 0, col)
            cols += [col, table[ids[at + o], n + j]]
        extra = [table[ids[at], 2 * n], table[ids[at], 2 * n + 1], table[ids[at], 2 * n + 2], table[ids[at - 1], 2 * n + 3], table[ids[at + 1], 2 * n + 4]]
        extra += [table[ids[at + o], 2 * n + 5 + j] for j, o in enumerate(LISTED)]
        cols += [np.where(blank.random(len(c)) < 0.15, 0, c) if blank is not None else c for c in extra]
        sp = np.array(spaced, np.int64)
        for name, a, b in (("L", -1, 0), ("R", 0, 1), ("LL", -2, -1), ("RR", 1, 2)):
            cols.append(self.pair(name, shp[ids[at + a]], shp[ids[at + b]], sp[at + b]))
        rows, run = np.array(self.run_rows, np.int32), np.array(runs)
        cols += [rows[run[at], 0], rows[run[at], 1], rows[run[at], 2], rows[run[at - 1], 3], rows[run[at + 1], 4]]
        return np.stack(cols, 1).astype(np.int32)

    def _run(self, x: str) -> tuple[int, int, int]:
        if not x:
            return 0, 0, 0
        if x[0] == "@":
            return self.f(f"run={x}"), 0, 0
        groups = re.findall(r"\d+", x)
        return self.f(f"run={x}"), self.f(f"digits={min(sum(map(len, groups)), 20)}"), self.f(f"groups={len(groups)}{x[0] if x[0] in '+(' else ''}")


def tokens(text: str) -> tuple[list[str], list[bool], list[str], list[tuple[int, int]]]:
    """Words, space-before flags, run shapes and places of the tokens of a text whose digits are all nines."""
    found = list(TOKEN.finditer(text))
    words, places = [m[0] for m in found], [m.span() for m in found]
    spaced = set(compress(range(1, len(text) + 1), map(str.isspace, text)))
    space = [a in spaced for a, _ in places]
    run = [""] * len(words)
    marks = [(m.start(), m.end(), m[0]) for m in RUN.finditer(text)] if "9" in text else []
    if "@" in text or "＠" in text or " at " in (low := text.lower()) or "[at]" in low or "(at)" in low:
        marks += [(m.start(), m.end(), "@" + ("x" if m[0][-1].isalpha() else "9") + (":" if re.match(r":\S", text[m.end() : m.end() + 2]) else "")) for m in MAILISH.finditer(text)]
    if marks:
        starts = [a for a, _ in places]
        for a, b, s in marks:
            i = bisect_left(starts, a)
            while i < len(starts) and places[i][1] <= b:
                if run[i][:1] != "@":
                    run[i] = s
                i += 1
    return words, space, run, places


def masked(text: str) -> str:
    """The text with every digit a nine; one character for one."""
    return text.encode().translate(_ASCII_NINE).decode() if text.isascii() else text.translate(NINE)


@lru_cache(maxsize=2)
def model(per_pattern: int = 16, epochs: int = 4, part: Part | None = None) -> tuple[Features, Crf]:
    """Train the field from the labelled table, or from a part of it; kept for the life of the process."""
    feats = Features()
    sents, ys = [], []
    for text, spans in labelled_table(per_pattern, part=part):
        words, space, run, places = tokens(masked(text))
        y = np.zeros(len(words), np.int64)
        for a, b, kind in spans:
            inside = [i for i, (x, z) in enumerate(places) if x >= a and z <= b]
            for n, i in enumerate(inside):
                y[i] = LABELS.index(("B-" if n == 0 else "I-") + kind)
        if words:
            sents.append((words, space, run))
            ys.append(y)
    x = feats.matrix(sents)
    feats.open = False
    rng = np.random.default_rng(3)
    hidden = feats.matrix(sents, rng)
    cuts = np.cumsum([len(y) for y in ys])[:-1]
    crf = Crf(len(feats.index), LABELS).fit(np.split(x, cuts) + np.split(hidden, cuts), ys + ys, epochs)
    feats.shape_of.setdefault("\u0003", len(feats.shape_of))
    feats.forget()
    return feats, crf


def _sound(kind: str, s: str) -> bool:
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        plain = re.sub(r"\s*[\[(]?\bdot\b[\])]?\s*", ".", re.sub(r"\s*(?:[\[(]at[\])]|＠|\bat\b)\s*", "@", s, flags=re.I), flags=re.I)
        return bool(re.fullmatch(r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}", plain))
    if kind == "phone":
        return 7 <= digits <= 15 and not re.search(r"[^\W\d_]", s)
    if kind == "id_number":
        return 8 <= sum(c.isalnum() for c in s) <= 20 and digits >= 6
    if kind == "address":
        return digits > 0 and bool(re.search(r"[^\W\d_]{2}", s)) and not COUNTED.fullmatch(s)
    words = re.findall(rf"[{HAN}]|[^\W\d_{HAN}]+", s)
    return digits == 0 and len(words) >= 2


def _trim(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[b - 1].isspace() or text[b - 1] in ",;:'\"<>/|=`，；。"):
        b -= 1
    while a < b and (text[a].isspace() or text[a] in ",;:'\"<>/|=`.，；。"):
        a += 1
    if kind in ("email", "phone", "id_number") or (kind == "address" and text[b - 1 : b] == "." and not re.search(r"(?:^|\W)(?:St|Ave|Rd|Blvd|Str|str|Apt|Dr|Ln|Ct)\.$", text[a:b])):
        while a < b and text[b - 1] == ".":
            b -= 1
    if kind == "address" and (unit := re.match(r",? (?:#\d+|(?:Apt|Suite|Unit|Flat)\.? \d+[a-z]?)\b", text[b:])):
        b += unit.end()
    if kind == "address" and text[b : b + 1] == "." and re.search(r"(?:^|\W)(?:Ave|(?:St|Rd|Blvd|Dr|Ln|Ct|Str|str)(?=\.[^\s]))$", text[a:b] if text[a:b].endswith("Ave") else text[a : b + 2]) is not None:
        b += 1
    if kind == "phone" and text[b - 1 : b] == ")" and "(" not in text[a:b]:
        b -= 1
    if kind == "phone" and text[a : a + 1] == "(" and ")" not in text[a:b]:
        a += 1
    return a, b


class Tagger:
    """Finds spans in texts; remembers the sentences it has decoded, up to ``memory`` of them."""

    def __init__(self, feats: Features, crf: Crf, memory: int = 150_000):
        self.feats, self.crf, self.memory = feats, crf, memory
        self.known: dict[str, tuple] = {}

    def _decode(self, new: list[str]) -> None:
        feats = self.feats
        if len(feats.words) > 50_000 or len(feats.run_ids) > 50_000:
            feats.forget()
        sents, owner, places = [], [], []
        for k, s in enumerate(new):
            words, space, run, at = tokens(s)
            if words:
                sents.append((words, space, run))
                owner.append(k)
                places.append(at)
        found: list[list] = [[] for _ in new]
        if sents:
            size = np.array([len(x[0]) for x in sents])
            y = self.crf.viterbi(feats.matrix(sents), size)
            ends = np.cumsum(size)
            hit = np.unique(np.searchsorted(ends, np.flatnonzero(y), "right"))
            for i in hit:
                lab = y[ends[i] - size[i] : ends[i]]
                k, at, open_ = owner[i], places[i], None
                for j, v in enumerate([*lab, 0]):
                    if open_ is not None and (v == 0 or v % 2 == 1):
                        found[k].append((KINDS[(lab[open_] - 1) // 2], at[open_][0], at[j - 1][1]))
                        open_ = None
                    if v and v % 2 == 1:
                        open_ = j
        for s, spans in zip(new, found):
            out = []
            for kind, a, b in spans:
                a, b = _trim(kind, s, a, b)
                if b > a and _sound(kind, s[a:b]):
                    out.append((kind, a, b))
            self.known[s] = tuple(out)

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) spans of each text, in order."""
        if len(self.known) > self.memory:
            self.known.clear()
        cut: list[list[tuple[int, str]]] = []
        new: dict[str, None] = {}
        for t in texts:
            pieces = []
            if t:
                plain, at = masked(t), 0
                for m in BREAK.finditer(plain):
                    if m.start() > at:
                        pieces.append((at, plain[at : m.start()]))
                    at = m.end()
                if at < len(plain):
                    pieces.append((at, plain[at:]))
                for _, s in pieces:
                    if s not in self.known:
                        new[s] = None
            cut.append(pieces)
        if new:
            self._decode(list(new))
        return [[(k, at + a, at + b) for at, s in pieces for k, a, b in self.known[s]] for pieces in cut]


def _tagger(df: DataFrame, per_pattern: int):
    box = df.sparkSession.sparkContext.broadcast(model(per_pattern))
    return lambda: Tagger(*box.value)


def find(df: DataFrame, id_col: str = "row_id", text_col: str = "msg_content", per_pattern: int = 16) -> DataFrame:
    """(row_id, pii_kind, surface): every piece of personal data, each surface once per row and kind."""
    make = _tagger(df, per_pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            rows, kinds, surfaces = [], [], []
            ids = b.column(0).to_pylist()
            for i, t, spans in zip(ids, texts, tagger.spans(texts)):
                for k, s in dict.fromkeys((k, t[x:y]) for k, x, y in spans):
                    rows.append(i)
                    kinds.append(k)
                    surfaces.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(kinds, pa.string()), pa.array(surfaces, pa.string())], names=["row_id", "pii_kind", "surface"])

    src = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(run, "row_id bigint, pii_kind string, surface string")


def redact(df: DataFrame, id_col: str = "row_id", text_col: str = "msg_content", per_pattern: int = 16) -> DataFrame:
    """(row_id, redacted, n_found): the text with each span replaced by [KIND]; null texts stay null."""
    make = _tagger(df, per_pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = make()
        for b in batches:
            texts, out, n = b.column(1).to_pylist(), [], []
            for t, spans in zip(texts, tagger.spans(texts)):
                for k, x, y in sorted(spans, key=lambda s: -s[1]):
                    t = f"{t[:x]}[{k.upper()}]{t[y:]}"
                out.append(t)
                n.append(len(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["row_id", "redacted", "n_found"])

    return spread(df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).alias("text"))).mapInArrow(run, "row_id bigint, redacted string, n_found int")
