"""SentencePiece encoding and decoding by a forward pass over a shared-prefix trie.

The distinct marked words of a batch are sorted; walking them in that order is
a depth-first traversal of their trie, and the forward state at depth d stays
valid for the next word as far as the two share a prefix. So each trie node is
computed once.

* Unigram models: the state of a prefix is its best score and last piece
  (Viterbi).
* BPE models: summing scores does not give the library's segmentation. The
  state is the last piece of the prefix's own segmentation: the piece t for
  which the last piece before t and t stay apart when both are merged alone.
  It is unique, depends on the prefix only, and gives the library's ids. The
  pieces that a prefix ends with are those of an automaton's state, which is
  kept beside it.

Texts are cut into words between two characters that stand side by side in no
piece, which is exact: no piece and no merge spans such a place. A word keeps
its ids, and whether they decode to the word itself, for as long as the memory
for it lasts; a text is put together from its words' ids, and decoded from them
one by one only if some word does not decode to itself.

Defined cases: a null or empty text has no ids and decodes to an empty string;
a character outside the vocabulary becomes its bytes or the unknown piece;
repeated rows are encoded row by row; empty tables give empty results; a very
long text is one slice, a word of any length takes time in proportion to it;
only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import give_back, sliced, texts_only

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Pieces of equal scores that texts are searched for; with more, every pair of pieces is merged to see if it stays apart.
MOST_TIED = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def shared_with_last(words: list[str], most: int = 32) -> list[int]:
    """How many characters each word shares with the one before it; the first ``most`` of all words are looked at together."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.array([x[:most] for x in words], f"U{most}").view(np.uint32).reshape(len(words), most)
    differ = np.ones((len(words), most + 1), bool)
    np.not_equal(first[1:], first[:-1], out=differ[1:, :most])
    out = np.minimum(differ.argmax(axis=1), lengths)
    out[1:] = np.minimum(out[1:], lengths[:-1])
    out[0] = 0
    for k in np.flatnonzero(out == most).tolist():
        a, b = words[k - 1], words[k]
        n, end = most, min(len(a), len(b))
        while n < end and a[n] == b[n]:
            n += 1
        out[k] = n
    return out.tolist()


class TrieEncoder:
    """Encodes and decodes with a .model file. Words seen lately keep their ids, in about ``memo_bytes`` at most."""

    def __init__(self, path: str, memo_bytes: int = 48 << 20):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            fields = dict(_fields(f.read()))
        self.kind = dict(_fields(fields.get(2, b""))).get(3, UNIGRAM)
        self.dummy_prefix = bool(dict(_fields(fields.get(3, b""))).get(3, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.memo_bytes = memo_bytes
        self._forget()
        n = p.vocab_size()
        self.unk = p.unk_id()
        normal = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.names = [p.id_to_piece(i) for i in range(n)]
        self.pieces = {self.names[i]: i for i in normal}
        self.scores = {self.names[i]: p.get_score(i) for i in normal}
        self.bytes_ids = {int(self.names[i][3:5], 16): i for i in range(n) if p.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_ids.items()}
        self.hidden = {i for i in range(n) if p.is_control(i)}
        #: All that pieces begin with: the states of an automaton that knows the longest of them that a prefix ends with.
        self.begun = {x[:k] for x in self.pieces for k in range(1, len(x) + 1)} | {""}
        #: By state and next character, put together: the next state and the pieces of several characters that it ends with.
        self.steps: dict[str, tuple[str, list[str]]] = {}
        pairs = {x[i : i + 2] for x in self.pieces for i in range(len(x) - 1)}
        chars = sorted({c for x in pairs for c in x})
        #: The number of each character that stands beside others in pieces, else 0; or the last, for unknown ones that become one piece.
        self.number = np.zeros(0x110000, np.uint16)
        if not self.bytes_ids:
            self.number[:] = len(chars) + 1
            self.number[[ord(x) for x in self.pieces if len(x) == 1]] = 0
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joint = np.zeros((len(chars) + 2,) * 2, bool)
        self.joint[-1, -1] = True
        for x in pairs:
            self.joint[self.number[ord(x[0])], self.number[ord(x[1])]] = True
        self.unk_score = min(self.scores.values(), default=0) - 10
        self.apart: dict[tuple[str, str], bool] = {}
        #: Of pieces that merging their own characters gives, the two parts of the last merge.
        self.halves: dict[str, tuple[str, str] | None] = {}
        merged = sorted((x for x in self.pieces if len(x) > 1), key=lambda x: -self.scores[x])
        self.turn = {x: k for k, x in enumerate(merged)}
        times = Counter(self.scores[x] for x in merged)
        #: Pieces of equal scores that hold no shorter one of them.
        self.tied: list[str] = []
        for x in sorted((x for x in merged if times[self.scores[x]] > 1), key=len):
            if len(self.tied) <= MOST_TIED and not any(y in x for y in self.tied):
                self.tied.append(x)

    @cached_property
    def backward(self) -> dict:
        """Pieces by their characters from the last to the first; "" marks the end of one."""
        out: dict = {}
        for piece in self.pieces:
            at = out
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = piece
        return out

    # -- BPE: do two pieces stay apart

    def _merge(self, text: str) -> list[str]:
        """Merge a short text by score, leftmost first."""
        parts: list[str | None] = list(text)
        right = list(range(1, len(parts) + 1))
        left = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(heap, (-score, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or len(parts[i]) + len(parts[j]) != size or right[i] != j:
                continue
            if size == len(text):
                self.halves[text] = parts[i], parts[j]
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in parts if x is not None]

    def _stay(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 150_000:
                self.apart.clear()
            found = self.apart[a, b] = self._reachable(b) and (self._merge(a + b) == [a, b] if self._may_tie(a + b) else self._never_joined(a, b))
        return found

    def _may_tie(self, text: str) -> bool:
        """Whether merges of equal scores can meet in a text."""
        return len(self.tied) > MOST_TIED or any(x in text for x in self.tied)

    def _never_joined(self, a: str, b: str) -> bool:
        """Whether no merge crosses from a to b: undo their merges, the latest first, and see at each state if the two parts
        at the border would have been merged before what was undone."""
        turn = self.turn
        before = len(turn)
        while True:
            if turn.get(a + b, before) < before:
                return False
            turn_a, turn_b = turn.get(a, -1), turn.get(b, -1)
            if turn_a < 0 and turn_b < 0:
                return True
            if turn_a > turn_b:
                before, a = turn_a, self._parts(a)[1]
            else:  # of equal merges the left one comes first
                before, b = turn_b + 1, self._parts(b)[0]

    def _parts(self, piece: str) -> tuple[str, str]:
        if piece not in self.halves:
            self._reachable(piece)
        return self.halves[piece]

    def _reachable(self, piece: str) -> bool:
        if len(piece) == 1:
            return True
        if piece not in self.halves and self._merge(piece) != [piece]:
            self.halves[piece] = None
        return self.halves[piece] is not None

    # -- forward states along a path of the trie

    def _step(self, key: str) -> tuple[str, list[str]]:
        """The longest end of the key that a piece begins with, and the pieces that it ends with, the longest first."""
        if len(self.steps) > 200_000:
            self.steps.clear()
        state = key
        while state not in self.begun:
            state = state[1:]
        ends = (state[k:] for k in range(len(state) - 1))
        found = self.steps[key] = state, [x for x in ends if x in self.pieces and self._reachable(x)]
        return found

    def _extend_bpe(self, word: str, start: int, last: list[str], states: list[str]) -> None:
        """Last pieces and states of the prefixes longer than ``start``."""
        steps, apart, state = self.steps, self.apart, states[-1]
        for i in range(start, len(word)):
            chosen = word[i]
            key = state + chosen
            found = steps.get(key)
            state, ends = self._step(key) if found is None else found
            for piece in ends:
                j = i + 1 - len(piece)
                if j:
                    fits = apart.get((last[j], piece))
                    if fits is None:
                        fits = self._stay(last[j], piece)
                    if not fits:
                        continue
                chosen = piece
                break
            last.append(chosen)
            states.append(state)

    def _extend_unigram(self, word: str, start: int, last: list[str], best: list[float]) -> None:
        """Last pieces and best scores of the prefixes longer than ``start``."""
        for i in range(start + 1, len(word) + 1):
            chosen = word[i - 1]
            top = best[i - 1] + self.scores.get(chosen, self.unk_score)
            at, j = self.backward.get(chosen), i - 2
            while at is not None and j >= 0:
                at = at.get(word[j])
                if at is not None and "" in at:
                    score = best[j] + self.scores[at[""]]
                    if score > top:
                        top, chosen = score, at[""]
                j -= 1
            last.append(chosen)
            best.append(top)

    def _ids(self, word: str, last: list[str]) -> list[int]:
        out: list[int] = []
        i = len(word)
        while i:
            piece = last[i]
            found = self.pieces.get(piece)
            if found is not None:
                out.append(found)
            elif self.bytes_ids:
                out.extend(self.bytes_ids[b] for b in reversed(piece.encode()))
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
            i -= len(piece)
        out.reverse()
        return out

    # -- words that are known

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}  # word -> number
        self.flat, self.stops, self.plain = array("i"), array("q", [0]), array("b")
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the memo, and whether they decode to the word."""
        names = self.names
        last, best, states = [""], [0.0], [""]
        found = sorted(words)
        for word, shared in zip(found, shared_with_last(found), strict=True):
            del last[shared + 1 :]
            if self.kind == BPE:
                del states[shared + 1 :]
                self._extend_bpe(word, shared, last, states)
            else:
                del best[shared + 1 :]
                self._extend_unigram(word, shared, last, best)
            ids = self._ids(word, last)
            self.memo[word] = len(self.plain)
            self.flat.extend(ids)
            self.stops.append(len(self.flat))
            self.plain.append("".join([names[i] for i in ids]) == word or self._text(ids) == word.replace(MARK, " "))
            self.held += 200 + 4 * len(word) + 4 * len(ids)

    def ids_of(self, word: str) -> list[int]:
        k = self.memo[word]
        return list(self.flat[self.stops[k] : self.stops[k + 1]])

    def encode_normal(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normalised texts one after another, n + 1 offsets, and whether all words of a text decode to themselves."""
        n = len(normal)
        whole = "".join(normal)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.ones(n, bool)
        ends = np.cumsum([0, *map(len, normal)])
        kinds = self.number[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = ~self.joint[kinds[:-1], kinds[1:]]
        cut[ends] = True
        places = np.flatnonzero(cut)
        at = places.tolist()
        words = [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
        fresh = set(words).difference(self.memo)
        if self.held > self.memo_bytes:
            self._forget()
            fresh = set(words)
        self.learn(fresh)
        known = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        # no array may be extended while numpy looks into it
        stops, flat, plain = (np.frombuffer(x, t).copy() for x, t in ((self.stops, np.int64), (self.flat, np.int32), (self.plain, np.int8)))
        sizes = stops[known + 1] - stops[known]
        before = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(stops[known] - before, sizes) + np.arange(int(sizes.sum()))]
        first = np.searchsorted(places, ends)
        bounds = np.append(before, len(ids))[first]
        odd = np.concatenate([[0], np.cumsum(plain[known] == 0)])[first]
        return ids, bounds, odd[1:] == odd[:-1]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds, _ = self.encode_normal([self.processor.normalize(x) if x else "" for x in texts])
        return np.split(ids, bounds[1:-1]) if texts else []

    # -- decoding

    def _text(self, ids) -> str:
        """Text of the ids: marks become blanks, runs of byte pieces are read as UTF-8."""
        parts: list[str] = []
        held = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            if i in self.hidden:
                continue
            parts.append(" ⁇ " if i == self.unk else self.names[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(MARK, " ")

    def unprefixed(self, text: str) -> str:
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self.unprefixed(self._text(ids))


def encode(docs: DataFrame, model: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, sha256 of the decoded text and whether it is the model's normal form of the text.

    No shuffle: each worker builds the tries of its own batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TrieEncoder(model)
        normalize = encoder.processor.normalize
        for batch in sliced(batches, 1, batch_bytes):
            normal = [normalize(x) if x else "" for x in batch.column(1).to_pylist()]
            ids, bounds, plain = encoder.encode_normal(normal)
            expected = [encoder.unprefixed(x.replace(MARK, " ")) for x in normal]
            decoded = [x if same else encoder.decode(ids[a:b].tolist()) for x, same, a, b in zip(expected, plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(batch.column(1)).cast(pa.int64()),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    pa.array([a == b for a, b in zip(decoded, expected, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )
        del encoder, normalize
        give_back()

    return texts_only(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCHEMA)


def decode(ids: Column | str, model: str) -> Column:
    """Texts of a column of ids."""
    held: dict[str, TrieEncoder] = {}

    @F.pandas_udf("string")
    def run(column):
        if model not in held:
            held[model] = TrieEncoder(model)
        return column.map(lambda x: None if x is None else held[model].decode(x.tolist()))

    return run(ids)
