"""SentencePiece encoding and decoding of texts of any length by a max-plus scan.

The encoding is the segmentation into vocabulary pieces with the largest sum of piece scores; characters without a piece
cost ten below the lowest score and become byte pieces. A text is cut into chunks of ``CHUNK`` characters. What a chunk knows of its
neighbours is the boundary state: by how many characters the piece across the boundary reaches into the next chunk. Each chunk
yields the matrix of best scores from every entry state to every exit state; matrices combine by the max-plus product,
which is associative, in a prefix scan; the scan gives every chunk its entry and exit, and each chunk is then
backtraced alone. Only texts longer than a chunk are spread over tasks this way; a text of one chunk has one entry and one exit.

Where no piece of the vocabulary joins two neighbouring characters, every segmentation has a cut. Stretches between such cuts
are solved once per worker and remembered, so the work follows the distinct stretches.

Decoding returns the text exactly: spaces are the mark U+2581, and that character itself is encoded as bytes.

Defined cases: null is empty and has no pieces; of several best paths one is taken, the same for the same text; repeated rows are encoded each; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvida.llm.common import written

CHUNK = 1 << 16
REMEMBERED, REMEMBERED_LENGTH, ROWS_AT_ONCE = 700_000, 64, 512
MARK, LITERAL_MARK = "▁", "\udfff"  # the space mark, and a stand-in for that character in a text
NONE = -1e300


class Vocabulary:
    """Pieces and scores of a model file, and the best segmentation of short stretches."""

    _by_path: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in every if sp.is_byte(i)}
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:k] for p in self.pieces for k in range(2, len(p))}
        joined = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        follow: dict[str, str] = {}
        for a, b in joined:
            follow[a] = follow.get(a, "") + b
        # A stretch goes on as long as some piece joins the two characters; one alternative per first character.
        steps = "|".join(f"{re.escape(a)}(?=[{''.join(map(re.escape, sorted(set(b))))}])" for a, b in sorted(follow.items()))
        self.stretch = re.compile(f"(?:{steps})*+.", re.S)
        # Where no piece goes on from another character to the mark, whole words are such stretches, or several in a row.
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if all(b != MARK or a == MARK for a, b in joined) else self.stretch
        self.words: dict[str, tuple[bytes, float]] = {}
        self.text_of = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.known: dict[str, tuple[bytes, float]] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def forward(self, text: str, begin: int, stop: int) -> tuple[list[float], list[int]]:
        """Best score of reaching each position from ``begin``, by pieces that start before ``stop``, and the piece's start."""
        n = len(text)
        best, link = [NONE] * (n + 1), [-1] * (n + 1)
        best[begin] = 0.0
        get, prefixes = self.pieces.get, self.prefixes
        for i in range(begin, min(stop, n)):
            here = best[i]
            if here == NONE:
                continue
            one = get(text[i])
            to = here + (self.unknown if one is None else one[1])
            if to > best[i + 1]:
                best[i + 1], link[i + 1] = to, i
            for j in range(i + 2, min(n, i + self.longest) + 1):
                part = text[i:j]
                piece = get(part)
                if piece is not None:
                    if here + piece[1] > best[j]:
                        best[j], link[j] = here + piece[1], i
                elif part not in prefixes:
                    break
        return best, link

    def path(self, text: str, link: list[int], begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            start = link[end]
            piece = self.pieces.get(text[start:end])
            if piece is not None:
                out.append(piece[0])
            else:
                raw = MARK if text[start] == LITERAL_MARK else text[start]
                out += [self.bytes[b] for b in reversed(raw.encode())]
            end = start
        return out[::-1]

    def best(self, stretch: str) -> tuple[bytes, float]:
        score, link = self.forward(stretch, 0, len(stretch))
        return np.array(self.path(stretch, link, 0, len(stretch)), dtype="<u4").tobytes(), score[-1]

    def solve(self, stretch: str) -> tuple[bytes, float]:
        got = self.known.get(stretch)
        if got is None:
            got = self.best(stretch)
            if len(stretch) <= REMEMBERED_LENGTH and len(self.known) < REMEMBERED:
                self.known[stretch] = got
        return got

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as packed bytes and the score of a marked text without neighbours."""
        words = self.word.findall(text)
        got = list(map(self.words.get, words))
        if None in got:
            for k, (word, g) in enumerate(zip(words, got)):
                if g is None:
                    stretches = self.stretch.findall(word)
                    parts = [self.best(word)] if len(stretches) == 1 else [self.solve(s) for s in stretches]
                    got[k] = g = (b"".join([p[0] for p in parts]), sum(p[1] for p in parts))
                    if len(word) <= REMEMBERED_LENGTH and len(self.words) < REMEMBERED:
                        self.words[word] = g
        return b"".join([g[0] for g in got]), sum([g[1] for g in got])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode()[1:]

    def digest(self, ids: bytes) -> tuple[int, int, str]:
        """Number of pieces, CRC-32 of the packed ids, SHA-256 of the decoded text."""
        return len(ids) // 4, zlib.crc32(ids), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    def _frame(self, text: str, size: int) -> tuple[int, int]:
        """The first cut at or after the last entry state, and the last cut at or before ``size`` (equal or crossed: none between)."""
        cuts = np.cumsum([0, *map(len, self.stretch.findall(text))])
        inner = cuts[(cuts >= min(self.longest - 1, size)) & (cuts <= size)]
        return (int(inner[0]), int(inner[-1])) if len(inner) else (-1, -1)

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best score from entry state to exit state; ``text`` is the chunk of ``size`` characters and what may follow a state.

        Both boundary states are counted in characters; pieces that start inside the chunk belong to it."""
        n = self.longest
        out = np.full((n, n), NONE)
        first, last = self._frame(text, size)
        middle = 0.0
        if first >= 0:
            middle = self.encode(text[first:last])[1]
            tail, _ = self.forward(text[last:], 0, size - last)
            ends = np.array([tail[size - last + s] if size - last + s < len(tail) else NONE for s in range(n)])
        for s in range(min(n, size + 1)):
            if first >= 0:
                head, _ = self.forward(text[:first], s, first)
                if head[first] > NONE:
                    out[s] = np.where(ends > NONE, head[first] + middle + ends, NONE)
            else:
                best, _ = self.forward(text, s, size)
                out[s] = [best[size + e] if size + e < len(best) else NONE for e in range(n)]
        for s in range(size + 1, n):  # a piece that covers the whole chunk
            out[s, s - size] = 0.0
        return out

    def between(self, text: str, size: int, enter: int, leave: int) -> bytes:
        """Ids of the chunk's own pieces on the best path from one state to the other."""
        if enter >= size:
            return b""
        end = size + leave
        _, link = self.forward(text[:end], enter, size)
        return np.array(self.path(text, link, enter, end), dtype="<u4").tobytes()


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(n, s, s) products over (max, +)."""
    return np.maximum((a[:, :, :, None] + b[:, None, :, :]).max(axis=2), NONE)


def boundary_states(matrices: np.ndarray) -> tuple[list[int], list[int], float]:
    """Entry and exit state of each chunk on the best path, and its score."""
    prefix = matrices.copy()
    shift = 1
    while shift < len(prefix):
        prefix[shift:] = max_plus(prefix[:-shift], prefix[shift:])
        shift *= 2
    leave = [0] * len(matrices)
    enter = [0] * len(matrices)
    for k in range(len(matrices) - 1, 0, -1):
        enter[k] = int(np.argmax(prefix[k - 1, 0] + matrices[k, :, leave[k]]))
        leave[k - 1] = enter[k]
    return enter, leave, float(prefix[-1, 0, 0])


def marked(text: str) -> str:
    return MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK) if text else ""


DIGEST = ("n_pieces", "ids_crc32", "decoded_sha256")


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, ident: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_chars, score, ids (little-endian 32-bit numbers); with ``digest`` their number and CRC-32 and the
    SHA-256 of the text decoded from them instead, so that the ids need not leave the task."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    large = F.char_length("text") >= chunk

    columns = "n_pieces long, ids_crc32 long, decoded_sha256 string" if digest else "ids binary"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary.of(model)
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS_AT_ONCE):
                batch = whole_batch.slice(at, ROWS_AT_ONCE)
                lengths, scores, out = [], [], []
                for t in batch.column(1):
                    t = t.as_py()
                    ids, score = v.encode(marked(t))
                    lengths.append(len(t))
                    scores.append(score)
                    out.append(v.digest(ids) if digest else (ids,))
                made = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(scores, pa.float64()), *made], names=["doc_id", "n_chars", "score", *(DIGEST if digest else ["ids"])])

    small = rows.where(~large).mapInArrow(whole, f"doc_id long, n_chars long, score double, {columns}")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = Vocabulary.of(model).longest - 1
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = marked(t.as_py())
                cut = [(uid, k, min(chunk, len(t) - k * chunk), t[k * chunk : (k + 1) * chunk + reach].encode("utf-8", "surrogatepass")) for k in range(-(-len(t) // chunk))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*cut), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["uid", "no", "size", "part"])

    giant = written(rows.where(large).select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", "text"))
    chunks = written(giant.dropDuplicates(["uid"]).select("uid", "text").mapInArrow(split, "uid long, no long, size long, part binary").repartition("uid", "no"))

    @F.arrow_udf("binary")
    def transfer(size: pa.Array, part: pa.Array) -> pa.Array:
        v = Vocabulary.of(model)
        return pa.array([v.matrix(p.as_py().decode("utf-8", "surrogatepass"), s.as_py()).tobytes() for s, p in zip(size, part)], pa.binary())

    matrices = chunks.select("uid", "no", transfer("size", "part").alias("m"))

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        n = Vocabulary.of(model).longest
        enter, leave, score = boundary_states(np.stack([np.frombuffer(m.as_py(), dtype=float).reshape(n, n) for m in table.column("m")]))
        return pa.table({"uid": table.column("uid"), "no": table.column("no"), "enter": pa.array(enter, pa.int64()), "leave": pa.array(leave, pa.int64()), "score": pa.array([score] * len(enter))})

    states = written(matrices.groupBy("uid").applyInArrow(combine, "uid long, no long, enter long, leave long, score double"))

    @F.arrow_udf("binary")
    def trace(size: pa.Array, part: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
        v = Vocabulary.of(model)
        return pa.array([v.between(p.as_py().decode("utf-8", "surrogatepass"), s.as_py(), a.as_py(), b.as_py()) for s, p, a, b in zip(size, part, enter, leave)], pa.binary())

    traced = chunks.join(states, ["uid", "no"]).select("uid", "no", "score", trace("size", "part", "enter", "leave").alias("ids"))
    joined = traced.groupBy("uid").agg(F.first("score").alias("score"), F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    ids = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b))
    done = giant.select("uid", "doc_id", F.char_length("text").cast("long").alias("n_chars")).join(joined, "uid").select("doc_id", "n_chars", "score", ids.alias("ids"))
    if digest:

        @F.arrow_udf("struct<n_pieces: long, ids_crc32: long, decoded_sha256: string>")
        def digests(ids: pa.Array) -> pa.Array:
            v = Vocabulary.of(model)
            return pa.StructArray.from_arrays([pa.array(c) for c in zip(*[v.digest(x.as_py()) for x in ids])] if len(ids) else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())], names=DIGEST)

        done = done.select("doc_id", "n_chars", "score", digests("ids").alias("d")).select("doc_id", "n_chars", "score", "d.*")
    return small.unionByName(done)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds the text of packed ids."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        v = Vocabulary.of(model)
        return pa.array([v.decode(x.as_py()) for x in ids], pa.string())

    return encoded.withColumn("text", text("ids"))


def round_trip(docs: DataFrame, model: str, chunk: int = CHUNK, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32, score, decoded_sha256."""
    return encode(docs, model, chunk, ident, text, digest=True).select("doc_id", "n_chars", "n_pieces", "ids_crc32", "score", "decoded_sha256")
