"""Byte-level BPE encoding as a streaming transducer with bounded lookahead, and its inverse.

Three state machines make up the encoder:

* the pre-tokenizer, which cuts text into pieces by character classes (its state at the end of
  what has been read is at most the last three pieces);
* the piece transducer, which applies the merges to a sliding window of bytes. The merge list
  determines how far to the right a byte can still change whether two tokens merge: the
  *sufficient lookahead* (:meth:`Vocabulary.lookahead`). A token boundary with so many known
  bytes behind it is final, its tokens are emitted and forgotten;
* the decoder, which turns token bytes into text as soon as a character is complete.

Memory is constant in the length of a text: the window and the held-back pieces.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' vocabulary files; every function takes another one.
TOKENIZERS = os.environ.get("LOOMLINE_TOKENIZERS", "/opt/tokenizers")
#: Characters that a text is cut into for the vectorised pre-tokenizer; longer texts are streamed.
CHUNK_CHARS = 1 << 20
#: Distinct pieces a Python worker remembers the tokens of; beyond it the memory starts anew. Speed only.
REMEMBERED_PIECES = 400_000
#: Bytes of a piece that one window of the piece transducer takes.
WINDOW = 4096

# Fixed values of the pattern: suffixes of English contractions after an apostrophe.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
#: Unicode White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_classes: np.ndarray | None = None


def character_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[[ord(c) for c in SPACES]] = SPACE
        _classes = table
    return _classes


def piece_starts(points: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Positions in ``points`` (code points of several texts, one behind the other) at which a piece starts.

    The texts start at ``row_starts``. Equals the usual pattern of byte-level BPE: contractions;
    a run of letters, of numbers or of other characters, each with one space before it; white
    space, whose last character stays with what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    classes = character_classes()[points]
    first_of_row = np.zeros(n, bool)
    first_of_row[row_starts[row_starts < n]] = True
    begins = first_of_row.copy()
    begins[0] = True
    begins[1:] |= classes[1:] != classes[:-1]
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    kind, length = classes[runs], ends - runs
    followed = np.zeros(len(runs), bool)
    followed[:-1] = ~first_of_row[runs[1:]]

    space = np.flatnonzero((kind == SPACE) & followed)
    begins[ends[space[length[space] > 1]] - 1] = True
    joins = space[points[ends[space] - 1] == 0x20]
    begins[runs[joins + 1]] = False

    quote = np.flatnonzero((kind == OTHER) & followed & (length == 1) & (points[runs] == 0x27))
    quote = quote[begins[runs[quote]] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[runs[quote + 1]]
        two = points[np.minimum(runs[quote + 1] + 1, n - 1)]
        takes = np.isin(one, [ord(c) for c in CONTRACTIONS_1]).astype(np.int64)
        long = length[quote + 1] > 1
        for a, b in CONTRACTIONS_2:
            takes[(one == ord(a)) & (two == ord(b)) & long] = 2
        hit = quote[takes > 0]
        after = runs[hit + 1] + takes[takes > 0]
        begins[runs[hit + 1]] = False
        begins[after[after < ends[hit + 1]]] = True
    return np.flatnonzero(begins)


class Vocabulary:
    """Tokens with their ranks; a token's id is its rank, and lower ranks merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self._lookahead: int | None = None
        self._tokens: dict[int, bytes] | None = None

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Vocabulary:
        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    @property
    def tokens(self) -> dict[int, bytes]:
        if self._tokens is None:
            self._tokens = {rank: token for token, rank in self.ranks.items()}
        return self._tokens

    def lookahead(self) -> int:
        """How many bytes behind a token boundary decide it for good: the merge list's sufficient lookahead.

        A token t ends at a boundary unless something to its right takes its last part away: a
        merge (y, z), where y is t or one of its last parts (its right spine), that comes before
        the merge in which y is used up. Whether z is there to be taken depends, in the same way,
        on merges of still lower rank to the right of z. Ranks fall strictly along such a chain,
        so reaches are computed in the order of ranks; the sufficient lookahead is the longest.
        """
        if self._lookahead is not None:
            return self._lookahead
        ranks = self.ranks
        spine: dict[bytes, list[tuple[bytes, int]]] = {}
        # steals[y]: ranks of the merges (y, z) so far, and the greatest reach among them.
        steals: dict[bytes, tuple[list[int], list[int]]] = {}

        def reach(token: bytes, limit: int) -> int:
            most = 0
            for part, used_by in spine[token]:
                if part in steals:
                    at, best = steals[part]
                    k = bisect_left(at, min(limit, used_by))
                    if k:
                        most = max(most, best[k - 1])
            return most

        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            forms = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            forms = [(y, z) for y, z in forms if ranks[y] < rank and ranks[z] < rank]
            parts = {token: 1 << 62}
            for _, z in forms:
                for part, used_by in spine[z]:
                    parts[part] = max(parts.get(part, 0), min(used_by, rank))
            spine[token] = list(parts.items())
            for y, z in forms:
                r = len(z) + reach(z, rank)
                at, best = steals.setdefault(y, ([], []))
                at.append(rank)
                best.append(max(r, best[-1]) if best else r)
        self._lookahead = max(reach(t, 1 << 62) for t in ranks)
        return self._lookahead

    def merge(self, window: bytes) -> list[bytes]:
        """Tokens of a window on its own: the pair of lowest rank first, of equal ones the leftmost."""
        ranks = self.ranks
        if window in ranks:
            return [window]
        n = len(window)
        if n <= 48:
            parts = [window[i : i + 1] for i in range(n)]
            get = ranks.get
            costs = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(n - 1)]
            while costs:
                low = min(costs)
                if low == 1 << 30:
                    break
                i = costs.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del costs[i]
                if i < len(costs):
                    costs[i] = get(parts[i] + parts[i + 1], 1 << 30)
                if i:
                    costs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
            return parts
        end = list(range(1, n + 1))  # end of the token that starts here
        before = list(range(-1, n - 1))  # start of the token before
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(window[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not alive[i] or middle >= n or not alive[middle] or end[middle] != stop:
                continue
            alive[middle] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(window[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(window[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(window[i : end[i]])
            i = end[i]
        return out


class PieceTransducer:
    """Tokens of one piece, fed in parts. Holds back what a later byte may still change."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW):
        self.vocabulary, self.held = vocabulary, b""
        self.window = max(window, 4 * (vocabulary.lookahead() + vocabulary.longest))

    def feed(self, more: bytes) -> list[int]:
        out: list[int] = []
        self.held += more
        while len(self.held) >= self.window:
            part = self.held[: self.window]
            stable, at = self.window - self.vocabulary.lookahead(), 0
            for token in self.vocabulary.merge(part):
                if at + len(token) > stable:
                    break
                out.append(self.vocabulary.ranks[token])
                at += len(token)
            self.held = self.held[at:]
        return out

    def finish(self) -> list[int]:
        ranks = self.vocabulary.ranks
        out = [ranks[t] for t in self.vocabulary.merge(self.held)] if self.held else []
        self.held = b""
        return out


class StreamEncoder:
    """Encodes a text fed in parts of any size, with memory that doesn't grow with the text."""

    KEEP = 3  # pieces that more text may still change: white space, apostrophe and letters

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK_CHARS):
        self.vocabulary, self.chunk = vocabulary, chunk
        self.carry, self.run, self.memory = "", None, {}

    def _piece(self, piece: bytes) -> list[int]:
        whole = PieceTransducer(self.vocabulary)
        return whole.feed(piece) + whole.finish()

    def _continue(self, text: str) -> tuple[list[int], str]:
        """Give the open piece (a very long run) its share of ``text``."""
        kind, transducer = self.run
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        other = np.flatnonzero(character_classes()[points] != kind)
        stop = int(other[0]) if len(other) else len(text)
        hold = len(text) == stop or kind == SPACE  # its last character may belong to what follows
        take = max(0, stop - 1) if hold else stop
        out = transducer.feed(text[:take].encode())
        if stop < len(text):
            out += transducer.finish()
            self.run = None
        return out, text[take:]

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        self.carry += text
        if self.run:
            out, self.carry = self._continue(self.carry)
        if self.run or not self.carry:
            return out
        points = np.frombuffer(self.carry.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, np.zeros(1, np.int64))
        stop = len(starts) - self.KEEP
        if stop > 0:
            bounds = [*starts[:stop].tolist(), int(starts[stop])]
            for a, b in zip(bounds, bounds[1:]):
                out += self._piece(self.carry[a:b].encode())
            self.carry = self.carry[bounds[-1] :]
            starts = starts[stop:] - bounds[-1]
        if len(self.carry) > self.chunk:  # the last run alone is that long: open it
            last = int(starts[-1])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                out += self._piece(self.carry[a:b].encode())
            tail = self.carry[last:]
            kind = int(character_classes()[ord(tail[min(1, len(tail) - 1)])])
            if len(tail) < 4:
                self.carry = tail
                return out
            self.run = (kind, PieceTransducer(self.vocabulary))
            out += self.run[1].feed(tail[:-1].encode())
            self.carry = tail[-1:]
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.run:
            kind, transducer = self.run
            # At the end of the text a run of white space keeps its last character.
            same = [character_classes()[ord(c)] == kind for c in self.carry]
            stop = same.index(False) if False in same else len(same)
            out += transducer.feed(self.carry[:stop].encode()) + transducer.finish()
            self.carry, self.run = self.carry[stop:], None
        if self.carry:
            points = np.frombuffer(self.carry.encode("utf-32-le"), np.uint32)
            bounds = [*piece_starts(points, np.zeros(1, np.int64)).tolist(), len(self.carry)]
            for a, b in zip(bounds, bounds[1:]):
                out += self._piece(self.carry[a:b].encode())
        self.carry = ""
        return out


class BatchEncoder:
    """Encodes many texts at once: pieces are found by array operations and each distinct one is merged once."""

    def __init__(self, vocabulary: Vocabulary, chunk: int = CHUNK_CHARS):
        self.vocabulary, self.chunk = vocabulary, chunk
        self.memory: dict[bytes, list[int]] = {}
        vocabulary.lookahead()

    def _tokens(self, piece: bytes) -> list[int]:
        found = self.memory.get(piece)
        if found is None:
            rank = self.vocabulary.ranks.get(piece)
            if rank is not None:
                found = [rank]
            else:
                transducer = PieceTransducer(self.vocabulary)
                found = transducer.feed(piece) + transducer.finish()
            if len(piece) <= 64:
                if len(self.memory) >= REMEMBERED_PIECES:
                    self.memory.clear()
                self.memory[piece] = found
        return found

    def _block(self, data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids per text and all ids of the texts in ``data``, which have ``lengths`` in bytes."""
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        row_bytes = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=row_bytes[1:])
        row_points = np.searchsorted(at, row_bytes)
        starts = piece_starts(points, row_points[:-1])
        if not len(starts):
            return np.zeros(len(lengths), np.int64), np.zeros(0, np.int32)
        offsets = np.append(at[starts], len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        tokens = [self._tokens(p) for p in coded.dictionary.to_pylist()]
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), np.int32, int(counts.sum()))
        first = np.cumsum(counts) - counts
        per_piece = counts[which]
        done = np.zeros(len(which) + 1, np.int64)
        np.cumsum(per_piece, out=done[1:])
        ids = flat[np.repeat(first[which] - done[:-1], per_piece) + np.arange(done[-1])]
        bounds = done[np.searchsorted(starts, row_points)]
        return np.diff(bounds), ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of ids per text, null counting as empty, and the ids of all texts, one behind the other."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
        counts, ids, a = [], [], 0
        while a < len(texts):
            if lengths[a] > self.chunk:
                encoder, text = StreamEncoder(self.vocabulary, self.chunk), texts[a].as_py()
                own = [i for k in range(0, len(text), self.chunk) for i in encoder.feed(text[k : k + self.chunk])] + encoder.finish()
                counts.append(np.array([len(own)]))
                ids.append(np.array(own, np.int32))
                a += 1
                continue
            b, total = a, 0
            while b < len(texts) and lengths[b] <= self.chunk and (b == a or total + lengths[b] <= self.chunk):
                total += int(lengths[b])
                b += 1
            start = int(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset + a])
            data = texts.buffers()[2].slice(start, total).to_pybytes() if total else b""
            c, i = self._block(data, lengths[a:b])
            counts.append(c)
            ids.append(i)
            a = b
        return (np.concatenate(counts), np.concatenate(ids)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.int32))


class StreamDecoder:
    """Text of token ids fed one after the other; a character comes out once its last byte is there.

    A state machine over bytes: the state is how many continuation bytes are missing and what
    they may be. Bytes that cannot form a character give U+FFFD, as usual for UTF-8.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.point, self.missing, self.low, self.high = vocabulary.tokens, 0, 0, 0x80, 0xBF

    def feed(self, ids: list[int]) -> str:
        out: list[str] = []
        for i in ids:
            for byte in self.tokens[i]:
                if self.missing:
                    if self.low <= byte <= self.high:
                        self.point, self.missing, self.low, self.high = self.point << 6 | byte & 0x3F, self.missing - 1, 0x80, 0xBF
                        if not self.missing:
                            out.append(chr(self.point))
                        continue
                    out.append("\ufffd")
                    self.missing = 0
                self.low, self.high = 0x80, 0xBF
                if byte < 0x80:
                    out.append(chr(byte))
                elif 0xC2 <= byte <= 0xDF:
                    self.point, self.missing = byte & 0x1F, 1
                elif 0xE0 <= byte <= 0xEF:
                    self.point, self.missing = byte & 0x0F, 2
                    self.low, self.high = (0xA0 if byte == 0xE0 else 0x80), (0x9F if byte == 0xED else 0xBF)
                elif 0xF0 <= byte <= 0xF4:
                    self.point, self.missing = byte & 0x07, 3
                    self.low, self.high = (0x90 if byte == 0xF0 else 0x80), (0x8F if byte == 0xF4 else 0xBF)
                else:
                    out.append("\ufffd")
        return "".join(out)

    def finish(self) -> str:
        cut, self.missing = "\ufffd" if self.missing else "", 0
        return cut


_encoders: dict[tuple[str, str], BatchEncoder] = {}


def worker_encoder(ranks: dict[bytes, int], name: str, folder: str) -> BatchEncoder:
    """The Python worker's encoder, kept from task to task."""
    if (name, folder) not in _encoders:
        _encoders[name, folder] = BatchEncoder(Vocabulary(ranks))
    return _encoders[name, folder]


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens. One narrow pass, no shuffle.

    Null and empty texts give an empty list; the text is encoded as stored; repeated rows and
    null keys stay as they are; further columns are not read. The vocabulary (a fixed size) is
    read by the driver and broadcast, so the executors need no copy of the file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(name, folder).ranks)
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks.value, name, folder)
        for batch in batches:
            counts, ids = encoder.encode(batch.column(1))
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=offsets[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["_key", "ids"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def count_tokens(docs: DataFrame, columns: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``columns`` and n_tokens (bigint), the number of ids that :func:`encode_documents` gives."""
    ranks = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(name, folder).ranks)
    source = docs.select(*columns, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks.value, name, folder)
        for batch in batches:
            counts, _ = encoder.encode(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(counts.astype(np.int64))], [*columns, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, n_tokens bigint")


def decode_documents(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text): the inverse of :func:`encode_documents`; null and empty lists give an empty text."""
    ranks = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(name, folder).ranks)
    source = encoded.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_encoder(ranks.value, name, folder).vocabulary
        for batch in batches:
            texts = []
            for one in batch.column(1).to_pylist():
                decoder = StreamDecoder(vocabulary)
                texts.append(decoder.feed(one or []) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_key", "text"])

    kind = source.schema["_key"].dataType.simpleString()
    return source.mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
