"""Problem 10: reading level of a text by smoothed unigram language models, one for each language and level.

The models are trained on the labelled samples (a table of fixed size; more than ``max_samples`` rows are refused,
so the bound on what reaches the driver is a parameter). A text is reduced to its prose: fenced and indented code,
log lines, commands, query and configuration lines, headings and list marks are left out. The level is the one with
the highest posterior likelihood over all languages at once, so the text's own ``lang`` is not needed. Log-likelihoods
of a batch are gathers from one table and segmented sums; nothing is shuffled.

Defined results: null texts, texts that are code or logs (less prose than ``least_prose`` of their letters) and
near-empty texts (fewer than ``least_units`` words or Chinese characters of prose) have a null level; repeated
texts count each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

HAN = "㐀-䶿一-鿿豈-﫿"
_FENCE = re.compile(r"^\s*(```|~~~)")
_LOG = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|(?:ERROR|WARN|INFO|DEBUG|TRACE|FATAL)\b)")
_CODE = re.compile(
    r"^\s*(?:\$ |> ?\$|#!|//|/\*|\*/|@\w+$|(?:def|class|fn|pub|func|import|from \S+ import|return|yield|let|const|var|if|for|while|else|elif|try|except|match|struct|enum|impl|use|package)\b.*[:;{}()]\s*$|"
    r"(?:SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|FROM|WHERE|GROUP BY|ORDER BY|LIMIT|JOIN|SET|VALUES)\b|\[[\w.\-]+\]\s*$|[\w.\-]+\s*=\s*\S|[\w.\-]+:\s*(?:[\w\"'\[{./\-]+)\s*$|[{}()\[\];,]+\s*$|.*[;{}]\s*$)"
)
_HEAD = re.compile(r"^\s*#{1,6}\s[^.!?。！？]{0,100}$|^\s*(?:[-=*_]\s*){3,}$")
_MARK = re.compile(r"^\s*(?:#{1,6}|[-*•+>]|\d{1,3}[.)])\s+")
_MARKS = set("#-*•+>0123456789")
_SPEAKER = re.compile(r"^\s*(?:\*\*)?(?:user|assistant|system|human|ai|tool|q|a|用户|助手)(?:\*\*)?\s*[:：]\s*", re.I)
_PATH = re.compile(r"`[^`\n]*`|https?://\S+|(?:[\w.\-]+/)+[\w.\-]+")
_ALNUM = re.compile(r"[^\W_]+")
_HAN_RUN = re.compile(f"[{HAN}]+")
_WORD = re.compile(rf"[^\W\d_{HAN}]+(?:['’][^\W\d_]+)?")


def prose(text: str) -> str:
    """The running text of a document, without code, logs, commands, headings and marks."""
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced or not line.strip() or line.startswith(("    ", "\t")) or _HEAD.match(line) or _LOG.match(line):
            continue
        if line.lstrip()[0] in _MARKS:
            line = _MARK.sub("", line)
        if ":" in line[:24] or "：" in line[:24]:
            line = _SPEAKER.sub("", line)
        if _CODE.match(line) or _LOG.match(line):
            continue
        out.append(_PATH.sub(" ", line) if "/" in line or "`" in line else line)
    return "\n".join(out)


def _letters(text: str) -> int:
    return sum(map(len, _ALNUM.findall(text)))


def _units(text: str) -> tuple[list[str], int]:
    """Units of a text and how many of them are words or single Chinese characters."""
    low = text.lower()
    out, pairs = [], 0
    for run in _HAN_RUN.findall(low):
        out += run
        out += map(str.__add__, run, run[1:])
        pairs += len(run) - 1
    out += _WORD.findall(low)
    return out, len(out) - pairs


def units(text: str) -> list[str]:
    """Lower-case words; of Chinese, characters and pairs of characters."""
    return _units(text)[0]


class LevelModel:
    """log P(unit | language, level) with Dirichlet smoothing towards the language and of the language towards all."""

    def __init__(self, samples: list[tuple[str, str, int]], mu: float = 60.0):
        counts: dict[tuple[str, int], Counter] = {}
        for text, lang, level in samples:
            counts.setdefault((lang or "", int(level)), Counter()).update(units(prose(text)))
        self.classes = sorted(counts)
        vocab = sorted({u for c in counts.values() for u in c})
        self.index = {u: i for i, u in enumerate(vocab)}
        n = np.array([[counts[c][u] for u in vocab] for c in self.classes], float).reshape(len(self.classes), len(vocab))
        base = (n.sum(0) + 0.5) / (n.sum() + 0.5 * max(len(vocab), 1)) if len(vocab) else np.zeros(0)
        langs = np.array([c[0] for c in self.classes])
        table = np.zeros_like(n)
        for lang in set(langs):
            rows = np.flatnonzero(langs == lang)
            own = n[rows].sum(0)
            bg = (own + mu * base) / (own.sum() + mu)
            table[rows] = np.log((n[rows] + mu * bg) / (n[rows].sum(1, keepdims=True) + mu))
        self.table = table.T.astype(np.float64)
        self.levels = np.array([c[1] for c in self.classes])

    def score(self, texts: list[str | None], least_units: int, least_prose: float) -> list[tuple[int | None, float | None, int]]:
        """(level, posterior of level >= 4, number of prose units) of each text. Log-likelihoods of many texts are summed
        by one gather and one segmented sum over the table."""
        out: list[tuple[int | None, float | None, int]] = []
        get, judged, ids, ends = self.index.get, [], [], []
        for t in texts:
            body = prose(t) if t else ""
            u, size = _units(body)
            out.append((None, None, size))
            if size < least_units or not len(self.classes):
                continue
            # letters are counted one by one only where the words alone don't decide
            if sum(map(len, u)) < 3 * least_prose * len(t) and _letters(body) < least_prose * _letters(t):
                continue
            own = [i for i in map(get, u) if i is not None]
            if own:
                judged.append(len(out) - 1)
                ids += own
                ends.append(len(ids))
        if not judged:
            return out
        scale = np.unique(self.levels)
        starts, at = [0, *ends[:-1]], np.array(ids)
        like = np.empty((len(judged), self.table.shape[1]))
        k = 0
        while k < len(judged):  # some 100,000 units at a time
            j = max(k + 1, bisect_right(ends, starts[k] + 100_000))
            like[k:j] = np.add.reduceat(self.table[at[starts[k] : ends[j - 1]]], np.array(starts[k:j]) - starts[k], axis=0)
            k = j
        post = np.exp(like - like.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        by = np.stack([post[:, self.levels == x].sum(1) for x in scale], 1)
        best, hard = scale[by.argmax(1)], post[:, self.levels >= 4].sum(1)
        for i, level, p in zip(judged, best.tolist(), hard.tolist()):
            out[i] = (level, p, out[i][2])
        return out


def train(samples: DataFrame, max_samples: int = 20_000) -> LevelModel:
    rows = samples.where("sample_text IS NOT NULL AND reading_level IS NOT NULL").select("sample_text", "lang", "reading_level").limit(max_samples + 1).collect()
    if len(rows) > max_samples:
        raise ValueError(f"more than {max_samples} labelled samples")
    return LevelModel([tuple(r) for r in rows])


def levels(docs: DataFrame, samples: DataFrame, least_units: int = 12, least_prose: float = 0.2, max_samples: int = 20_000) -> DataFrame:
    """(doc_id, reading_level, p_demanding, n_units) of every document; reading_level null where there is no prose to judge."""
    box = docs.sparkSession.sparkContext.broadcast(train(samples, max_samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = box.value.score(b.column(1).to_pylist(), least_units, least_prose)
            cols = [b.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "reading_level", "p_demanding", "n_units"])

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))).mapInArrow(run, "doc_id bigint, reading_level int, p_demanding double, n_units int")


def demanding(docs: DataFrame, samples: DataFrame, at_least: int = 4, **kw) -> DataFrame:
    return levels(docs, samples, **kw).where(F.col("reading_level") >= at_least).select("doc_id")
