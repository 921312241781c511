"""SentencePiece encoding and decoding by a shared-prefix forward pass.

Texts are marked (a blank becomes U+2581, one is put first) and split before each run of marks and about separators, where
no piece reaches across: two characters that stand together in no piece never merge. The distinct marked words of a batch are sorted, which lays them out as the depth-first order of their trie: a
word keeps the forward states of the prefix that it shares with the word before it, and only the rest is computed.

For a unigram model the state of a prefix is its Viterbi score and last piece. The public vocabulary at hand is a BPE
model, whose encoding isn't the best sum of scores, so there the state is the last piece of the prefix's encoding: of the
pieces that end at a place exactly one follows the encoding before it without a merge across the seam that the merge order
would have preferred. The pass is the same, the test of scores gives way to that test of neighbours, and the ids are those of the library.
Words that begin with several marks are merged directly, as pieces of marks alone share one score.

Decoding joins the pieces' bytes, turns marks into blanks and takes the first away. A text comes back as it was, unless it
holds U+2581, which becomes a blank: its round_trip is false.

Defined cases: a null text is empty and has no pieces; a very long text is encoded whole, word by word; of merges that tie by score the leftmost is made; characters outside the vocabulary become byte pieces; repeated rows
each give a row; an empty table gives no row; other columns aren't read. A worker remembers a fixed number of short words.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidestep.llm.common import sliced, texts_of
from tidestep.llm.token_counts import batches_of, vocabulary_path

MARK = "▁"
MOST_CACHED, LONGEST_CACHED = 3 << 17, 48
_loaded: dict[str, PieceModel] = {}


def _wordlike(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


class PieceModel:
    """Pieces, scores and marks of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without text normalisation are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.unigram = spec.trainer_spec.model_type == 1
        kind = type(spec.pieces[0])
        plain = {kind.NORMAL, kind.USER_DEFINED, kind.UNUSED}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type in plain}
        self.scores = [p.score for p in spec.pieces]
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kind.UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kind.BYTE}
        #: Every ending of a piece, and whether it is a piece itself.
        self.tails = {p[k:]: False for p in self.ids for k in range(1, len(p))} | dict.fromkeys(self.ids, True)
        self.unknown_score = min(self.scores) - 10.0
        self.bytes_of = [b""] * len(spec.pieces)
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        self.words = self._splitter()
        self._fits: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}

    def _splitter(self) -> re.Pattern:
        """A pattern that finds marked words: runs of marks, then characters of one of two kinds between which no piece reaches.

        Separators are characters that are neither letters nor digits and that no piece has beside a character of the other kind.
        """
        beside: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:], strict=False):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        # characters beyond the basic plane would slow the pattern down for every other one
        apart = {c for p in self.ids for c in p if not _wordlike(c) and c != MARK and c < "\U00010000"} | {c for c in map(chr, range(128)) if not _wordlike(c)}
        while odd := {c for c in apart if beside.get(c, set()) - apart - {MARK}}:
            apart -= odd
        own = "".join(map(re.escape, sorted(apart)))
        return re.compile(f"{MARK}*(?:[{own}]+|[^{own}{MARK}]+)|{MARK}+" if own else f"{MARK}*[^{MARK}]+|{MARK}+")

    def merged(self, word: str) -> list[str]:
        """Byte-pair encoding by its definition: the pair of the best score, then the leftmost, becomes one piece, until none is left."""
        parts: list[str | None] = list(word)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.ids.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, j, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= n or after[i] != j or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether two pieces stay apart when they stand next to each other."""
        found = self._fits.get((left, right))
        if found is None:
            if len(self._fits) > 1 << 18:
                self._fits.clear()
            found = self._fits[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return found

    def id_bytes(self, pieces: list[str]) -> bytes:
        """Their ids as 32-bit integers; a character outside the vocabulary as its bytes."""
        out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return array("i", out).tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct marked words, by one depth-first pass over their trie."""
        out: dict[str, bytes] = {}
        last: list[str] = [""]  # the last piece of each prefix's encoding
        score: list[float] = [0.0]
        previous = ""
        tails, ids, fits, known = self.tails, self.ids, self.fits, self._fits
        for word in sorted(words):
            if not self.unigram and word.startswith(MARK * 2):
                out[word] = self.id_bytes(self.merged(word))
                continue
            shared, most = 0, min(len(word), len(previous), len(last) - 1)
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                begin, found = end - 1, []
                while begin >= 0 and (whole := tails.get(word[begin:end])) is not None:
                    if whole:
                        found.append(begin)
                    begin -= 1
                best, best_score = word[end - 1 : end], -1e300  # a character outside the vocabulary
                if self.unigram:
                    for begin in found:
                        if (value := score[begin] + self.scores[ids[word[begin:end]]]) > best_score:
                            best, best_score = word[begin:end], value
                    if (end - 1 not in found) and (value := score[end - 1] + self.unknown_score) > best_score:
                        best, best_score = word[end - 1 : end], value
                else:
                    for begin in reversed(found):
                        pair = last[begin], word[begin:end]
                        if known[pair] if pair in known else fits(*pair):
                            best = pair[1]
                            break
                last.append(best)
                score.append(best_score)
            pieces, at = [], len(word)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            out[word] = self.id_bytes(pieces[::-1])
            previous = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        marked = [self.words.findall(self.prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > MOST_CACHED:
            cache.clear()
        new = {w for x in marked for w in x if w not in cache}
        cache.update(self.encode_words(list(new)))
        out = [np.frombuffer(b"".join(map(cache.__getitem__, x)), dtype=np.int32) for x in marked]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def model_of(vocabulary: str) -> PieceModel:
    """Loaded once a worker."""
    if vocabulary not in _loaded:
        _loaded[vocabulary] = PieceModel(vocabulary_path(vocabulary))
    return _loaded[vocabulary]


def encode_texts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", *, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row; round_trip: decoding the ids gives the text back. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary)
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            for own in batches_of([len(t) for t in texts], batch_bytes):
                found = model.encode(texts[own])
                sizes = np.array([len(x) for x in found], dtype=np.int64)
                same = [model.decode(x.tolist()) == t for x, t in zip(found, texts[own], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0)[own.start : own.stop], pa.array(sizes), ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_texts(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("token_ids")).mapInArrow(run, "doc_id long, text string")
