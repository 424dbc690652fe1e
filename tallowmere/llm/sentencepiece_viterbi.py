"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model's pieces are merged in the order of their scores. The result for a prefix is one path through its
lattice, and it extends the result of a shorter prefix by one piece: the only piece whose merge with the
piece before it gives just these two again. So the search keeps, for each place, the start of its last
piece; what ends at a place looks back by the longest piece at most. Places behind that window are needed
by no later one, and when the back-pointers of all places in the window lead through one boundary, the ids
up to there are final and are committed. Memory is bounded by the longest piece between such boundaries,
whatever the text's length.

No piece has white space inside, so every space that follows another sign is such a boundary; a worker
caches the ids of the words between them (a fixed number of words), and searches only what it hasn't seen.

Nulls are empty texts and give no ids. Repeated rows are encoded each on their own. Decoding ignores control
ids, joins the pieces, reads byte pieces as UTF-8 (what isn't UTF-8 becomes the replacement sign) and takes
off the space that encoding puts in front. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import slices, text_or_empty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Pieces:
    """The pieces of a model file and what its merges give."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.piece = [model.id_to_piece(k) for k in range(n)]
        self.unknown = model.unk_id()
        self.control = frozenset(k for k in range(n) if model.is_control(k))
        self.bytes = {int(self.piece[k][3:-1], 16): k for k in range(n) if model.is_byte(k)}
        special = self.control | set(self.bytes.values()) | {self.unknown}
        self.ids = {p: k for k, p in enumerate(self.piece) if k not in special}
        self.score = {p: model.get_score(k) for p, k in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.ends = [*map(self._content, range(n))]
        self.inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.pairs: dict = {}
        # pieces that merges of their own signs give, and their lengths, longest first, by their last two signs
        self.standing = {p for p in self.ids if len(p) > 1 and self.merged(p) == [p]}
        by_end: dict[str, set] = {}
        for p in self.standing:
            by_end.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {e: tuple(sorted(n, reverse=True)) for e, n in by_end.items()}

    def _content(self, k: int) -> bytes:
        if k in self.control:
            return b""
        p = self.piece[k]
        return bytes([int(p[3:-1], 16)]) if k in self.bytes.values() else " ⁇ ".encode() if k == self.unknown else p.replace(SPACE, " ").encode()

    def merged(self, signs: str) -> list[str]:
        """Merges by score, the highest first and the leftmost of equals; for a few signs."""
        parts = list(signs)
        while True:
            best = max(((self.score[m], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether merges leave the two pieces beside each other as they are."""
        key = (left, right)
        if key not in self.pairs:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            self.pairs[key] = self.merged(left + right) == [left, right]
        return self.pairs[key]

    def id_bytes(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]


class StreamingViterbi:
    """Takes signs in runs of any length, yields ids as soon as they are final."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.signs = ""  # those after the last committed boundary
        self.start: list[int] = [0]  # of the last piece of each prefix of `signs`; a boundary is at 0
        self.before: str | None = None  # the piece before that boundary
        self.peak = 0

    def feed(self, run: str) -> Iterator[int]:
        p, pairs, window = self.p, self.p.pairs, 2 * self.p.longest
        lengths, standing = p.lengths, p.standing
        for c in run:
            self.signs += c
            signs, start = self.signs, self.start
            end = len(signs)
            for n in lengths.get(signs[-2:], ()):
                begin = end - n
                if begin >= 0 and (piece := signs[begin:]) in standing:
                    left = signs[start[begin] : begin] if begin else self.before
                    if left is None or (pairs[left, piece] if (left, piece) in pairs else p.follows(left, piece)):
                        start.append(begin)
                        break
            else:
                start.append(end - 1)  # a sign of its own: nothing longer ends here
            if end > window:
                self.peak = max(self.peak, end)
                yield from self._commit()

    def _commit(self) -> Iterator[int]:
        """Ids up to the last boundary through which all places of the window lead back."""
        end = len(self.signs)
        ways = set(range(max(1, end - self.p.longest + 1), end + 1))
        while len(ways) > 1:  # the furthest steps back until all have met
            last = max(ways)
            ways.discard(last)
            ways.add(self.start[last])
        meet = ways.pop()
        if meet:
            yield from self._ids(meet)
            self.before = self.signs[self.start[meet] : meet]
            self.signs = self.signs[meet:]
            self.start = [0, *(max(0, s - meet) for s in self.start[meet + 1 :])]

    def _ids(self, end: int) -> list[int]:
        out: list[list[int]] = []
        while end:
            out.append(self.p.id_bytes(self.signs[self.start[end] : end]))
            end = self.start[end]
        return [k for ids in reversed(out) for k in ids]

    def finish(self) -> Iterator[int]:
        yield from self._ids(len(self.signs))
        self.signs, self.start, self.before = "", [0], None


def encode_stream(pieces: Pieces, runs: Iterable[str]) -> Iterator[int]:
    """The ids of a text that comes in runs of signs."""
    search, first = StreamingViterbi(pieces), True
    for run in runs:
        if run:
            yield from search.feed((SPACE if first else "") + run.replace(" ", SPACE))
            first = False
    yield from search.finish()


def decode(pieces: Pieces, ids: Iterable[int]) -> str:
    text = b"".join(map(pieces.ends.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


class Encoder:
    """Ids of whole texts as bytes (four a id, little-endian), with a cache of words."""

    def __init__(self, path: str, words: int = 500_000):
        self.pieces, self.room = Pieces(path), words
        self.cache: dict[str, bytes] = {}
        self.line_feeds = "\n" not in self.pieces.inner
        self.feed_ids = self._search("\n") if self.line_feeds else b""

    def _search(self, signs: str) -> bytes:
        search = StreamingViterbi(self.pieces)
        return np.fromiter((k for part in (search.feed(signs), search.finish()) for k in part), "<u4").tobytes()

    def _known(self, lead: str, word: str, spare: dict) -> bytes:
        key = lead + word
        found = self.cache.get(key) or spare.get(key)
        if found is None:
            found = spare[key] = self._search(key)
            if len(self.cache) < self.room and len(key) <= 64:
                self.cache[key] = found
        return found

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for part in slices(texts):
            spare: dict = {}
            for text in part:
                if not text:
                    yield b""
                    continue
                text = text.replace(SPACE, " ")  # the model takes both for the same
                out: list[bytes] = []
                for at, line in enumerate(text.split("\n") if self.line_feeds else [text]):
                    if at:
                        out.append(self.feed_ids)
                    lead = "" if at else SPACE
                    for k, word in enumerate(line.split(" ")):
                        # several spaces in a row stay together with the word after them
                        lead += SPACE * (k > 0)
                        if word:
                            out.append(self.cache.get(lead + word) or self._known(lead, word, spare))
                            lead = ""
                    if lead:
                        out.append(self._known(lead, "", spare))
                yield b"".join(out)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id_col, n_ids, ids_crc32 (of the ids as little-endian 32-bit), round_trip and, if asked for, the ids and the text decoded from them of every row."""

    def run(batches):
        encoder = _encoder(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = part.column("text").to_pylist()
                ids = list(encoder.encode(texts))
                lists = [np.frombuffer(i, "<u4") for i in ids]
                decoded = [decode(encoder.pieces, i.tolist()) for i in lists]
                same = [d == t for d, t in zip(decoded, texts)]
                columns = [part.column("id"), pa.array([len(i) for i in lists], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)]
                if with_ids:
                    ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_ids", "ids_crc32", "round_trip", "ids", "decoded"][: 4 + 2 * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>, decoded string" * with_ids)
    return out.withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and the text of every row's ids; null ids give a null text."""

    def run(batches):
        pieces = _encoder(model_path).pieces
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if i is None else decode(pieces, i) for i in b.column("ids").to_pylist()], pa.string())], ["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
