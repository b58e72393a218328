"""Fill-in-the-middle transformation, with cuts looked up in a piecewise-linear learned rank index.

1. A text is cut into tokens: a word with the white space before it, and white space at the end of the text.  The ends of
   all tokens of an Arrow batch of documents form one ascending array of byte offsets.
2. ``RankIndex`` learns rank -> offset: a shrinking cone of slopes gives the longest line from each segment's first offset
   that stays within ``ERROR`` bytes of all its offsets, and the difference of each offset from its line is kept in one
   byte.  A lookup predicts with the segment's line and adds the residual, so it is exact; nothing holds 64-bit offsets.
3. A document's two cuts are token ranks drawn from a hash of its id.  Its form is drawn from the same hash: ``plain``,
   ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its marker.

No shuffle; a task holds one batch of bounded size, or one long text.

Cases: null text counts as empty; empty texts and texts that hold a marker stay plain; a text of blanks is one token; a
null doc_id is hashed as no digits; repeated rows give equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm.arrays import bounded_batches, flat, slices, spread, word_bounds

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 50
SPM_PERCENT = 80
SEED = 42
# With the rounding of a prediction, residuals stay below 128.
ERROR = 120
_HEAD = struct.Struct("<qq")

CUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
                    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


class RankIndex:
    """rank -> offset of an ascending array: lines with a bounded error, and a byte a rank for the rest."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residual: np.ndarray) -> None:
        self.first, self.base, self.slope, self.residual = first, base, slope, residual

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> RankIndex:
        offsets = np.asarray(offsets, np.int64)
        first, slope = [], []
        i, n = 0, len(offsets)
        while i < n:
            low, high, end, step = -np.inf, np.inf, i + 1, 256
            while end < n:
                run = np.arange(end - i, min(end + step, n) - i)
                rise = (offsets[i + run] - offsets[i]).astype(np.float64)
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                shut = lows > highs
                k = int(shut.argmax()) if shut.any() else len(run)
                if k:
                    low, high = lows[k - 1], highs[k - 1]
                end += k
                if k < len(run):
                    break
                step *= 2
            first.append(i)
            slope.append((low + high) / 2 if end > i + 1 else 0.0)
            i = end
        out = cls(np.array(first, np.int64), offsets[first] if n else offsets, np.array(slope), np.zeros(n, np.int8))
        gap = offsets - out.predict(np.arange(n))
        if n and np.abs(gap).max() > 127:
            raise ValueError(f"error {error} is too large for one byte a rank")
        out.residual = gap.astype(np.int8)
        return out

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, "right") - 1
        return self.base[at] + np.rint(self.slope[at] * (rank - self.first[at])).astype(np.int64)

    def offsets(self, rank: np.ndarray) -> np.ndarray:
        """The exact offsets of ``rank``."""
        if not len(rank):
            return np.zeros(0, np.int64)
        return self.predict(rank) + self.residual[rank]

    def to_bytes(self) -> bytes:
        return _HEAD.pack(len(self.first), len(self.residual)) + b"".join(
            x.astype(k).tobytes() for x, k in ((self.first, "<i8"), (self.base, "<i8"), (self.slope, "<f8"), (self.residual, "i1")))

    @classmethod
    def from_bytes(cls, raw: bytes) -> RankIndex:
        m, n = _HEAD.unpack_from(raw, 0)
        at = [_HEAD.size + 8 * m * i for i in range(4)]
        return cls(*(np.frombuffer(raw, k, c, a) for k, c, a in (("<i8", m, at[0]), ("<i8", m, at[1]), ("<f8", m, at[2]), ("i1", n, at[3]))))


def token_ends(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of all texts as offsets into ``data``, and the number of tokens before each text."""
    _, ends, woffs = word_bounds(data, offs)
    # A text that ends in white space has one more token; its end is the text's end.
    last = np.full(len(offs) - 1, -1, np.int64)
    worded = np.diff(woffs) > 0
    last[worded] = ends[woffs[1:][worded] - 1]
    tail = np.flatnonzero((np.diff(offs) > 0) & (last != offs[1:]))
    ends = np.insert(ends, woffs[1:][tail], offs[1:][tail])
    more = np.zeros(len(offs), np.int64)
    more[tail + 1] = 1
    return ends, woffs + np.cumsum(more)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the hash of seed and id."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


def _chars(part: np.ndarray) -> int:
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def fill_middle(docs: DataFrame, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, error: int = ERROR) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars and middle_chars (code points; null if plain), output, for every row of
    ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def cut(ids: list[int | None], data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        ends, before = token_ends(data, offs)
        index = RankIndex.fit(ends, error)
        n = np.diff(before)
        drawn = np.array([draws(d, seed) for d in ids], np.int64).reshape(-1, 4)
        cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
        rank = before[:-1, None] + cuts - 1
        at = np.repeat(offs[:-1, None], 2, axis=1)
        at[cuts > 0] = index.offsets(rank[cuts > 0])
        forms, prefix, middle, out = [], [], [], []
        for i in range(len(ids)):
            a, b, c, d = int(offs[i]), int(at[i, 0]), int(at[i, 1]), int(offs[i + 1])
            text = data[a:d].tobytes()
            if not text or drawn[i, 2] % 100 >= fim_percent or p in text or s in text or m in text:
                forms.append("plain")
                prefix.append(None)
                middle.append(None)
                out.append(text)
                continue
            x, y, z = text[: b - a], text[b - a: c - a], text[c - a:]
            spm = drawn[i, 3] % 100 < spm_percent
            forms.append("spm" if spm else "psm")
            prefix.append(_chars(data[a:b]))
            middle.append(_chars(data[b:c]))
            out.append(b"".join((s, z, p, x, m, y) if spm else (p, x, s, z, m, y)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                           pa.array(out, pa.binary()).cast(pa.string())], CUT.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = flat(batch.column(1))
            for i, j in slices(offs):
                yield cut(ids[i:j], data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, CUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_middle`` was made from.  Texts hold no marker, so the first one found is it."""
    def parts(second: str) -> tuple[Column, Column, Column]:
        i, j = F.locate(second, output), F.locate(MIDDLE, output)
        k, rest = F.lit(len(second)), F.length(output)
        return F.substring(output, F.lit(len(PREFIX) + 1), i - len(PREFIX) - 1), F.substring(output, i + k, j - i - k), F.substring(output, j + len(MIDDLE), rest)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as w from t),
r as (select *, len(w) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3,
    cast('0x' || h[25:32] as bigint) as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {FIM_PERCENT} then 'plain'
    when h4 % 100 < {SPM_PERCENT} then 'spm' else 'psm' end as form from r),
p as (select *, array_to_string(w[1:a], '') as x, array_to_string(w[a + 1:b], '') as y, array_to_string(w[b + 1:], '') as z from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(y) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y
    else '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y end) as output_sha256, sha256(text) as restored_sha256
from p
"""
