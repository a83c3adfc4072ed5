"""Token packing by best-two-fit.

Documents become token ids plus one end id; only those above the capacity are cut. The packing is planned on the
histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus size): a bin is filled greedily with the
longest piece that fits, then its smallest piece is exchanged for two unpacked pieces that fill the larger gap more
tightly, as long as that helps. A planned bin is repeated as often as the counts allow, so the plan holds for any number of
rows. Pieces then take their places by their rank within their length; the rank comes from salted buckets, so a length
that a third of all rows share is spread like any other.

Defined cases: null text is empty; an empty text is one piece of length 1; an empty table gives no rows; repeated rows
are packed each; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvida.llm.common import KEPT, trim, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OTHER_SPACE = "\t\n\x0b\x0c\r"
CACHED_WORDS, CACHED_LENGTH = 250_000, 48
SEEN = 1 << 20
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]*)")  # the tokenizer parts letters from marks and folds case, so such words share their parts


class WordCache:
    """Token ids per white-space word as packed bytes. The tokenizer drops white space and never joins words, so a text's
    ids are its words' ids in a row; frequent words are encoded twice per worker at most. A new word of letters and closing marks takes the
    ids of its lower-case letters and of its marks. Parts and the words that come a second time (a table of 1 MB marks what
    was seen) are kept, in one table, since a part is a word too: the first ``CACHED_WORDS`` of both."""

    _by_path: dict[str, WordCache] = {}

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.seen = bytearray(SEEN)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)  # ids that end a part
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> WordCache:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _keep(self, fresh: Iterable[tuple[str, bytes]]) -> None:
        seen, known = self.seen, self.known
        for w, b in fresh:
            if len(known) >= CACHED_WORDS:
                return
            k = hash(w) % SEEN
            if seen[k]:
                if len(w) <= CACHED_LENGTH:
                    known[w] = b
            else:
                seen[k] = 1

    def _each(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """One call for all: a part is one run for the tokenizer, so its ids go up to the next one that ends a run."""
        if not parts:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        cut = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(cut) != len(parts) or cut[-1] != 4 * len(ids):  # a tokenizer of another make
            return self._each(parts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def _encode(self, words: list[str]) -> list[bytes]:
        cut = [(m[1].lower(), m[2]) if (m := PLAIN.fullmatch(w)) else (w, None) for w in words]
        known, odd = self.known, [w for w, marks in cut if marks is None]
        new = list({p for pair in cut if pair[1] is not None for p in pair if p not in known})
        fresh = dict(zip(new, self._encode_parts(new)))
        whole = set(words)  # these are kept as words
        if len(known) < CACHED_WORDS:
            known.update((p, b) for p, b in fresh.items() if p not in whole and len(p) <= CACHED_LENGTH)
        fresh |= zip(odd, self._each(odd))

        def of(p):
            return fresh[p] if p in fresh else known[p]

        return [of(a) if b is None else of(a) + of(b) for a, b in cut]

    def ids(self, text: str) -> bytes:
        for c in OTHER_SPACE:
            text = text.replace(c, " ")
        words = text.split(" ")
        got = list(map(self.known.get, words))
        if None in got:
            new = list({w for w, b in zip(words, got) if b is None})
            fresh = dict(zip(new, self._encode(new)))
            got = [fresh[w] if b is None else b for w, b in zip(words, got)]
            self._keep(fresh.items())
        return b"".join(got)


def _clear_words() -> bool:
    had = bool(WordCache._by_path)
    WordCache._by_path.clear()
    return had


KEPT.append(_clear_words)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on request."""
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what earlier operators freed in this worker goes back before the cache grows
        cache, done = WordCache.of(tokenizer), 0
        for batch in batches:
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                packed = cache.ids(t.as_py() or "") + end
                for k in range(0, len(packed), step):
                    part = packed[k : k + step]
                    rows.append((key, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            cols = list(zip(*rows)) or [[]] * 5
            arrays = [pa.array(c, type=t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, type=pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            done += batch.nbytes
            if done > 1 << 24:  # what the tokenizer needed for these texts goes back
                done = 0
                trim()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Planned bins as ({length: pieces per bin}, number of such bins)."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    index = np.arange(capacity + 1)
    while counts.any():
        left, bin_, gap = counts.copy(), Counter(), capacity
        below = np.maximum.accumulate(np.where(left > 0, index, 0))
        while gap and (length := int(below[gap])):
            k = int(min(left[length], gap // length))
            bin_[length] += k
            left[length] -= k
            gap -= k * length
            if not left[length]:
                below = np.maximum.accumulate(np.where(left > 0, index, 0))
        while gap:
            small = min(bin_)
            room = gap + small
            first = index[1 : room][left[1:room] > 0]
            second = below[room - first]
            same = (second == first) & (left[first] < 2)
            second[same] = below[first[same] - 1]
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= small:
                break
            best = len(total) - 1 - int(np.argmax(total[::-1]))
            bin_[small] -= 1
            left[small] += 1
            for length in (int(first[best]), int(second[best])):
                bin_[length] += 1
                left[length] -= 1
            bin_ = +bin_
            gap = room - int(total[best])
            below = np.maximum.accumulate(np.where(left > 0, index, 0))
        times = min(int(counts[length]) // k for length, k in bin_.items())
        for length, k in bin_.items():
            counts[length] -= times * k
        plan.append((dict(bin_), times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first sequence, offset), sorted by length and rank."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for bin_, times in plan:
        at = 0
        for length, k in sorted(bin_.items(), reverse=True):
            rows.append((length, used[length], k, sequence, at))
            used[length] += times * k
            at += length * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """Adds ``rank``: gapless from 0 within each length, by salted buckets that grow in number with the rows."""
    salts = max(256, pieces.count() // rows_per_bucket)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    per = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    per = written(per.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return pieces.join(per, ["length", "bucket"]).withColumn("rank", F.col("before") + own - 1).drop("bucket", "before")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset; ids too when ``with_ids``."""
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, with_ids, ident, text))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    table = places(plan_bins(histogram, capacity))
    sent = pieces.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        t = sent.value
        key = (t[:, 0] << 48) + t[:, 1]
        ln, rk = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        row = t[np.searchsorted(key, (ln << 48) + rk, side="right") - 1]
        nth = rk - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * ln)], names=["sequence_id", "offset"])

    return ranked(pieces).withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
