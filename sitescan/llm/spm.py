"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search walks the text once and keeps, per position, the best path's last piece. Two kinds of model are read:

* ``unigram``: a path's score is the sum of its pieces' scores and each position keeps its best predecessor;
* ``bpe``: a path is possible only if merging would leave every pair of neighbouring pieces alone, which holds for exactly
  one path to each position; following it gives the ids of the merge procedure without ever merging the text.

Pieces are at most `longest` characters, so only that many positions can still be left by a future piece. Once the
backpointer paths of all of them meet in one boundary, everything before it is final: its ids are committed and forgotten.
Memory is bounded by the window, whatever the text's length.

Spaces become U+2581 and one is put in front, as in the model; nothing else is normalised. A character that no piece
covers, and a literal U+2581, become the ids of their UTF-8 bytes, so decoding gives back every text exactly. Null and
empty texts have no ids and decode to the empty text. Rows that repeat are answered row by row; no rows give none. `encode` returns its own
columns only, so others of the input may have any name; `decode` replaces a column that has its output's name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SPACE = "▁"
#: Stands for a literal U+2581 of a text: a lone surrogate, which no valid text has. It is written as U+2581's bytes.
_LITERAL, _BARE = "\udfff", "\udffe"
#: Remembered by a worker: two generations of windows of this size each, beginnings of windows of `_STEM` characters, and pairs.
_CACHE, _STEM, _STEMS, _PAIRS = 100_000, 6, 80_000, 250_000
_PAIR = (2,)


class Vocabulary:
    """Pieces and scores of a model, and the encoder's tables made from them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int], kind: str = "bpe"):
        self.kind, self.pieces, self.scores, self.byte_ids = kind, pieces, scores, byte_ids
        skip = special | set(byte_ids)
        self.ids = {p: i for i, p in enumerate(pieces) if i not in skip}
        self.longest = max(map(len, self.ids))
        ends: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        #: by last three characters, the lengths of the pieces that end in them, longest first; 2 stands for any pair
        self.ends = {c: (*sorted(n, reverse=True), 2) for c, n in ends.items()}
        self.unknown = min(scores) - 10.0
        # a boundary is certain before a run of U+2581 if no piece has one after another character
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.by_words = not inner
        self.cut = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if not any("\n" in p for p in self.ids) else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.text = pa.array([bytes([byte_ids.index(i)]) if i in set(byte_ids) else b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)], pa.binary())
        self.pairs: dict[int, bool] = {}  # by (first id << 32) + second id
        self.split: dict[str, tuple[str, str]] = {}
        self.stems: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def load(path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        bytes_ = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in n if m.is_unknown(i) or m.is_control(i)}
        return Vocabulary([m.id_to_piece(i) for i in n], [m.get_score(i) for i in n], bytes_, special, kind)

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for short texts: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge makes this one; the piece twice if it is a character."""
        found = self.split.get(piece)
        if found is None:
            parts, found = list(piece), (piece, piece)
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    k = self.ids.get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or self.scores[k] > best):
                        best, at = self.scores[k], i
                if at < 0:
                    break
                found = (parts[at], parts[at + 1])
                parts[at : at + 2] = ["".join(found)]
            self.split[piece] = found
        return found

    def stays(self, a: int, b: int) -> bool:
        """Merging the text of these two neighbouring pieces gives the two again.

        Takes the merges back, the latest first: the two stay if no merge over their border would have come before it.
        """
        found = self.pairs.get((a << 32) + b)
        if found is None:
            left, right, limit, found = self.pieces[a], self.pieces[b], float("inf"), True
            if left[-1] == right[0] == SPACE:  # runs of spaces have equal scores: merge them as they are
                found = self.merged(left + right) == [left, right]
                self.pairs[(a << 32) + b] = found
                return found
            while True:
                k = self.ids.get(left + right)
                if k is not None and -self.scores[k] < limit:
                    found = False
                    break
                x = -self.scores[self.ids[left]] if len(left) > 1 else float("-inf")
                y = -self.scores[self.ids[right]] if len(right) > 1 else float("-inf")
                if x > y:
                    limit, left = x, self.halves(left)[1]
                elif len(right) > 1:
                    limit, right = y + 0.5, self.halves(right)[0]
                else:
                    break
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            self.pairs[(a << 32) + b] = found
        return found

    def _walk(self, text: str, end: int, stop: int, base: int, last: list[int], back: list[int], score: list[float]) -> None:
        """Extend the tables from position `end` to `stop`; index 0 of the tables is position `base`."""
        piece_id, ends, stays = self.ids.get, self.ends.get, self.stays
        if self.kind == "bpe":
            known, add, put = self.pairs.get, last.append, back.append
            for end in range(end + 1, stop + 1):
                i = end - base
                for n in ends(text[end - 3 : end], _PAIR) if i > 2 else (i,):
                    if n <= i:
                        k = piece_id(text[end - n : end])
                        if k is not None:
                            p = last[i - n]
                            if p < 0 or (ok if (ok := known((p << 32) + k)) is not None else stays(p, k)):
                                add(k)
                                put(n)
                                break
                else:
                    add(piece_id(text[end - 1], -2))
                    put(1)
            return
        for end in range(end + 1, stop + 1):
            i = end - base
            best, piece, size = score[i - 1] + self.unknown, -2, 1
            for n in (1, *ends(text[end - 3 : end], _PAIR)) if i > 2 else range(1, i + 1):
                k = piece_id(text[end - n : end]) if n <= i else None
                if k is not None and score[i - n] + self.scores[k] > best:
                    best, piece, size = score[i - n] + self.scores[k], k, n
            last.append(piece)
            back.append(size)
            score.append(best)

    def search(self, text: str) -> Iterator[int]:
        """Ids of a text (spaces already replaced), each given out as soon as it is certain."""
        for ids in self.commits(text):
            yield from ids

    def ids_of(self, text: str) -> bytes:
        out = array("i")
        for ids in self.commits(text):
            out.extend(ids)
        return out.tobytes()

    def commits(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, those between two boundaries at a time."""
        longest, base, end = self.longest, 0, 0  # base: text position of index 0 of the window
        last, back, score = [-1], [0], [0.0]  # of each position: id of the piece that ends here (-2: none), its length, the path's score
        if self.kind == "bpe" and len(text) > _STEM and (stem := self.stems.get(text[:_STEM])):
            # the tables of a beginning do not depend on what follows
            (last, back), end = map(list, stem), _STEM
        while True:
            stop = min(len(text), base + 4 * longest)
            self._walk(text, end, stop, base, last, back, score)
            if base == end == 0 and stop > _STEM and self.kind == "bpe":
                if len(self.stems) >= _STEMS:
                    self.stems.clear()
                self.stems[text[:_STEM]] = tuple(last[: _STEM + 1]), tuple(back[: _STEM + 1])
            end = stop
            if end == len(text):
                yield self._path(text, base, end - base, last, back)
                return
            live = set(range(end - base - longest + 1, end - base + 1))
            while len(live) > 1:
                far = max(live)
                live.remove(far)
                live.add(far - back[far])
            at = live.pop()
            if at > 0:
                yield self._path(text, base, at, last, back)
                base += at
                del last[:at], back[:at], score[:at]
                back[0] = 0
            else:  # no common boundary yet: look further
                stop = min(len(text), end + longest)
                self._walk(text, end, stop, base, last, back, score)
                end = stop

    def _path(self, text: str, base: int, at: int, last: list[int], back: list[int]) -> list[int]:
        out: list[int] = []
        while at > 0:
            if last[at] >= 0:
                out.append(last[at])
            else:
                c = text[base + at - 1]
                out.extend(self.byte_ids[b] for b in reversed((SPACE if c == _LITERAL else c).encode("utf-8")))
            at -= back[at]
        return out[::-1]

    def _window(self, window: str) -> bytes:
        """Ids of a window that follows a single space, remembered, if short, among the recent ones."""
        if "\n" in window:
            return self._windows(SPACE + window)
        found = self.older.get(window)
        return self._remember(window, self.ids_of(SPACE + window) if found is None else found)

    def _windows(self, text: str) -> bytes:
        """Ids of a text cut at all certain boundaries."""
        if not self.by_words:
            return self.ids_of(text)
        out, get = [], self.cache.get
        for w in self.cut.findall(text):
            if w[0] == SPACE and w[1:2] not in ("", SPACE):
                out.append(get(w[1:]) or self._window(w[1:]))
            else:  # a mark that no text has keeps these apart from windows behind a space
                key = _BARE + w
                out.append(get(key) or self.older.get(key) or self._remember(key, self.ids_of(w)))
        return b"".join(out)

    def _remember(self, key: str, ids: bytes) -> bytes:
        if len(key) <= 64:
            if len(self.cache) >= _CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[key] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as int32 bytes.

        Where no piece has U+2581 behind another character, all paths have a boundary before every run of spaces: the window closes
        there, and its ids are committed. Windows between single spaces that were searched lately are not searched again."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        words = text.split(" ")
        if self.by_words and "" not in words:
            get, window = self.cache.get, self._window
            return b"".join([get(w) or window(w) for w in words])
        # runs of spaces are pieces of their own kind
        return self._windows(SPACE + text.replace(" ", SPACE))


_loaded: dict[tuple[str, str], Vocabulary] = {}


def _vocabulary(path: str, kind: str) -> Vocabulary:
    """The model, read once per Python worker; `path` must be readable there, as a file shipped with the job is."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = Vocabulary.load(path, kind)
    return _loaded[path, kind]


def _encoded(v: Vocabulary, texts: list[str | None]) -> pa.ListArray:
    ids = [v.encode(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _decoded(v: Vocabulary, ids: pa.ListArray) -> list[str]:
    ids = ids.fill_null([]) if ids.null_count else ids
    lens = ids.value_lengths().to_numpy()
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), v.text.take(ids.flatten()))
    # the space that encoding put in front goes again
    return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in pc.binary_join(pieces, b"").to_pylist()]


def encode(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, text (as it came), ids array<int>; with `decoded`, also the text that these ids are decoded to, in the same pass."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model, kind)
        for batch in slices(batches, 1):
            ids = _encoded(v, batch.column(1).to_pylist())
            more = [pa.array(_decoded(v, ids), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids, *more], ["doc_id", "text", "ids", "decoded"][: 3 + decoded])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, model: str, kind: str = "bpe", ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `df`, and `out`, in place of a column of that name: the text that its ids stand for. Ids outside the model raise an
    error."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model, kind)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_decoded(v, batch.column(ids_col)), pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)
