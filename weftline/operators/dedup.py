"""Problem 5: exactly one row of each message that was delivered more than once.

Identifiers of fixed width (128-bit UUIDs however written) go through a Feistel permutation of two 64-bit halves.
A permutation is a bijection, so nothing is lost: the leading bits choose the shard, the next ones (the quotient) the
home slot, and the rest (the complete remainder) is stored. Slot and remainder give the identifier back, so there are
no false matches. Since the permutation mixes all bits, the rows of a hot session spread
evenly over the shards; only ids, times and row numbers are shuffled, never message texts.

Defined results: rows with a null or blank session_id or msg_uuid are never dropped; ids that are not 32
hexadecimal digits in some usual spelling are compared as trimmed lower-case text in the same tables; of equal
messages the earliest ``received_at`` stays (null last), among equals the smallest ``row_id`` (null last; a dropped row
without a row_id comes out as null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import parts

_ROUNDS = (11, 23, 37, 53)
_LAST = 2**63 - 1
#: Leading bits of a permuted id that make its shard.
SHARD_BITS = 20
#: Rows a task gathers before it inserts them.
RUN = 50_000
_UUID = r"^(?:urn:uuid:)?[{(\[]?[0-9a-f]{8}-?(?:[0-9a-f]{4}-?){3}[0-9a-f]{12}[})\]]?$"


def hex_id(c: Column) -> Column:
    """The 32 lower-case hexadecimal digits of an id in any usual spelling, null if it has none."""
    low = F.lower(F.btrim(c, F.lit(" \t\r\n ﻿\"'")))
    return F.when(low.rlike(_UUID), F.regexp_replace(F.regexp_replace(low, "^urn:uuid:", ""), "[^0-9a-f]", ""))


def permuted(digits: Column) -> tuple[Column, Column]:
    """Both halves of a 128-bit id after a Feistel network; a bijection whatever the round function."""
    left, right = (F.conv(F.substring(digits, i, 16), 16, -10).cast("bigint") for i in (1, 17))
    for k in _ROUNDS:
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(k)))
    return left, right


class QuotientTable:
    """Exact quotient hash table: open addressing by quotient, complete remainders in the slots.

    The leading ``bits`` bits of a permuted identifier are its quotient, its home slot. A slot stores the other
    128 - ``bits`` bits and how far it lies from home, so slot and remainder give the identifier back: two entries are
    equal only if their identifiers are. The code beside them tells sessions and odd spellings apart. All steps are
    numpy gathers over whole arrays; every probe settles a pending row or moves it on.
    """

    def __init__(self, rows: int):
        """``rows``: the most identifiers it will hold; half of the slots stay free."""
        self.bits = max(8, int(2 * rows - 1).bit_length())
        self.away = np.full(1 << self.bits, -1, np.int32)  # -1: free
        self.rest, self.low = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.code = np.zeros(1 << self.bits, np.int64)

    def insert(self, hi: np.ndarray, lo: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Insert each identifier once; of equal ones the first row given goes in. True for rows that went in."""
        home = (hi >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = hi << np.uint64(self.bits)
        went_in = np.zeros(len(hi), bool)
        at, away = np.arange(len(hi)), 0
        while len(at):
            slot = (home[at] + away) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.away[slot] < 0)
            claim, first = np.unique(slot[free], return_index=True)
            new = at[free[first]]
            self.away[claim], self.rest[claim], self.low[claim], self.code[claim] = away, rest[new], lo[new], code[new]
            went_in[new] = True
            known = (self.away[slot] == away) & (self.rest[slot] == rest[at]) & (self.low[slot] == lo[at]) & (self.code[slot] == code[at])
            at = at[~known]
            away += 1
        return went_in


def repeated(df: DataFrame, row_col: str = "row_id", id_col: str = "msg_uuid", session_col: str = "session_id", received_col: str = "received_at") -> DataFrame:
    """(row_id) of every row that is not kept. One shuffle of narrow rows, by quotient shard."""
    digits = hex_id(F.col(id_col))
    text = F.lower(F.trim(F.col(id_col)))
    known = (F.coalesce(F.trim(F.col(session_col)), F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    d = df.where(known).select(F.coalesce(F.col(row_col).cast("bigint"), F.lit(_LAST)).alias("row_id"), F.col(session_col).alias("session"), F.coalesce(F.unix_micros(F.col(received_col).cast("timestamp")), F.lit(_LAST)).alias("received"), digits.alias("digits"), F.when(digits.isNull(), text).alias("other"))
    # ids of another shape get halves from their text and are told apart by the text itself
    width = F.coalesce(F.col("digits"), F.substring(F.sha2("other", 256), 1, 32))
    hi, lo = permuted(width)
    d = d.select("row_id", "received", "session", "other", hi.alias("hi"), lo.alias("lo"))
    # sorted by quotient shard, a task holds the table of a few shards at a time however many rows its partition has;
    # the sort is the JVM's and spills
    d = d.withColumn("shard", F.shiftrightunsigned("hi", 64 - SHARD_BITS).cast("int")).repartition(parts(df.sparkSession), "shard").sortWithinPartitions("shard")

    def settle(wait: list[pa.RecordBatch], lost: list[pa.RecordBatch]) -> pa.Table:
        """Insert the rows of a run of shards; those that lost go to ``lost``, those of the last shard that went in come back."""
        t = pa.Table.from_batches(wait).combine_chunks()
        t = t.take(pc.sort_indices(t, [("received", "ascending"), ("row_id", "ascending")]))
        names = pc.binary_join_element_wise(t["session"], pc.fill_null(t["other"], ""), "\x00").combine_chunks().dictionary_encode()
        hi, lo = (t[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        hi = (hi << np.uint64(SHARD_BITS)) | (hi >> np.uint64(64 - SHARD_BITS))  # neighbouring shards differ in their leading bits only
        went_in = QuotientTable(t.num_rows).insert(hi, lo, np.asarray(names.indices).astype(np.int64))
        lost.append(pa.RecordBatch.from_arrays([t["row_id"].combine_chunks().filter(pa.array(~went_in))], names=["row_id"]))
        return t.filter(pa.array(went_in & (t["shard"].to_numpy() == wait[-1]["shard"][-1].as_py())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        lost: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                wait.append(b)
            if sum(x.num_rows for x in wait) >= RUN:
                wait = settle(wait, lost).to_batches()  # the last shard may go on: who went in meets the rest of it
                yield lost.pop()
        if wait:
            settle(wait, lost)
            yield lost.pop()

    return d.mapInArrow(run, "row_id bigint").select(F.nullif("row_id", F.lit(_LAST)).alias("row_id"))


def unique(df: DataFrame, **names: str) -> DataFrame:
    """The rows that stay, with all their columns."""
    row = names.get("row_col", "row_id")
    return df.join(repeated(df, **names).withColumnRenamed("row_id", row), row, "left_anti")
