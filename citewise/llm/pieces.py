"""SentencePiece encoding and decoding over a lattice of substrings joined to the piece table.

The words that make up nearly all of the texts go through the relational lattice once (see lattice.py); their pieces, a
bounded number, are sent to all tasks. One pass then writes every text as its words' pieces. Rare and very long words
are folded in that pass, over the same lattice of substrings as arrays. The model at hand is a merge (BPE) model, so
both folds take the best-scored edge that joins two neighbouring symbols, leftmost first, until none is left; a path
of highest score sum would be a valid segmentation but not the one the model defines.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from citewise.llm.common import add_columns, by_parts, slices
from citewise.llm.lattice import AT_ONCE, KNOWN, SPACE, Cuts, known_words, piece_frame
from citewise.llm.spans import gather

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NONE = np.int64(1) << 62
CELLS = 1 << 20  # lattice cells held at once
CACHED = 120_000  # rare words a worker remembers
ARRAY_WORD = 512  # characters; longer words are folded by a queue of pairs
DECODED_ROWS = 256
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Pieces:
    """The piece table of a model file: hashes of pieces for the join, scores, and bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        texts = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.longest = max((len(texts[i]) for i in plain), default=1)
        self.cuts = Cuts([texts[i] for i in plain])
        keys = np.array([self._hash_one(texts[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        self.taken = np.zeros(1 << 22, bool)  # by the hash's upper bits: most substrings are no pieces
        self.taken[self.keys >> np.uint64(42)] = True
        self.rank = np.array([-model.get_score(i) for i in ids]).round().astype(np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        spelled = []
        for i in ids:
            if model.is_byte(i):
                value = int(texts[i][1:-1], 16)
                self.byte_ids[value] = i
                spelled.append(bytes([value]))
            else:
                spelled.append(b"" if model.is_control(i) or model.is_unknown(i) else texts[i].replace(SPACE, " ").encode())
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.rows = [(texts[i], int(self.rank[i]), i) for i in plain]
        self.by_text = {text: (rank, i) for text, rank, i in self.rows}
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _hash_one(text: str) -> np.uint64:
        return list(Pieces.hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32)[None, :], len(text)))[-1][0, 0]

    @staticmethod
    def hashes(codes: np.ndarray, longest: int):
        """For every length up to the longest: (words, starts), the hash of the substring of that length at every start."""
        codes = codes.astype(np.uint64) + np.uint64(1)
        h = np.zeros_like(codes)
        for length in range(1, longest + 1):
            h = _mixed((h[:, : codes.shape[1] - length + 1] + codes[:, length - 1 :]) * FACTOR)
            yield h

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, starts, lengths): id and rank of the piece on every edge, NONE where there is no piece."""
        n, size = codes.shape
        widest = min(self.longest, size)
        ids = np.full((n, size, widest), -1, np.int32)
        ranks = np.full((n, size, widest), NONE)
        for length, h in enumerate(self.hashes(codes, widest), 1):
            word, start = np.nonzero(self.taken[h >> np.uint64(42)])
            asked = h[word, start]
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[at] == asked
            word, start, found = word[hit], start[hit], self.ids[at[hit]]
            ids[word, start, length - 1] = found
            ranks[word, start, length - 1] = self.rank[found]
        return ids, ranks

    def fold(self, ranks: np.ndarray) -> np.ndarray:
        """(words, starts): end of the symbol that starts there, 0 inside a symbol."""
        n, size, widest = ranks.shape
        end = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))  # start of the symbol left of a start; entry size is the last symbol
        pair = np.full((n, size), NONE)
        if widest > 1:
            pair[:, :-1] = ranks[:, :-1, 1]
        live = np.arange(n)

        def joined(word, start, stop):
            length = stop - start
            fits = (start >= 0) & (length <= widest)
            return np.where(fits, ranks[word, np.maximum(start, 0), np.minimum(length, widest) - 1], NONE)

        while len(live):
            b = np.argmin(pair[live], axis=1)
            go = pair[live, b] < NONE
            live, b = live[go], b[go]
            if not len(live):
                break
            m = end[live, b]
            e = end[live, m]
            end[live, b], end[live, m] = e, 0
            pair[live, m] = NONE
            before[live, e] = b
            more = e < size
            after = np.where(more, end[live, np.minimum(e, size - 1)], 0)
            pair[live, b] = np.where(more, joined(live, b, np.where(more, after, b + 1)), NONE)
            p = before[live, b]
            has = p >= 0
            pair[live[has], p[has]] = joined(live[has], p[has], e[has])
        return end

    def fold_long(self, word: str) -> np.ndarray:
        """Ids of one long word: a queue holds the pairs that join, the best and leftmost first."""
        size = len(word)
        end, before = list(range(1, size + 1)), list(range(-1, size))
        queue: list[tuple[int, int, int, int]] = []

        def offer(start: int, middle: int) -> None:
            if start >= 0 and middle < size and end[middle] - start <= self.longest:
                found = self.by_text.get(word[start : end[middle]])
                if found:
                    heapq.heappush(queue, (found[0], start, middle, end[middle]))

        for i in range(size - 1):
            offer(i, i + 1)
        while queue:
            _, start, middle, stop = heapq.heappop(queue)
            if end[start] != middle or end[middle] != stop:
                continue  # one of the two has been joined otherwise
            end[start], end[middle] = stop, 0
            if stop < size:
                before[stop] = start
            offer(before[start], start)
            offer(start, stop)
        ids: list[int] = []
        at = 0
        while at < size:
            found = self.by_text.get(word[at : end[at]])
            ids += [found[1]] if found else self.byte_ids[list(word[at : end[at]].encode())].tolist()
            at = end[at]
        return np.array(ids, np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word, in arrays of words of one length at a time."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            if word not in self.known:
                by_length.setdefault(len(word), []).append(word)
        if len(self.known) + sum(map(len, by_length.values())) > CACHED:
            self.known.clear()
            by_length = {}
            for word in words:
                by_length.setdefault(len(word), []).append(word)
        for size, same in by_length.items():
            if size > ARRAY_WORD:
                self.known.update((word, self.fold_long(word)) for word in same)
                continue
            step = max(1, CELLS // (size * min(self.longest, size)))
            for at in range(0, len(same), step):
                some = same[at : at + step]
                codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                ids, ranks = self.lattice(codes)
                end = self.fold(ranks)
                word_at, start = np.nonzero(end)
                piece = ids[word_at, start, end[word_at, start] - start - 1]
                cuts = np.searchsorted(word_at, np.arange(len(some) + 1))
                odd = set(word_at[piece < 0].tolist())
                raw = piece.astype(np.int32)
                for w, word in enumerate(some):
                    own = raw[cuts[w] : cuts[w + 1]]
                    if w in odd:
                        parts = [[i] if i >= 0 else self.byte_ids[list(word[s].encode())].tolist() for i, s in zip(own.tolist(), start[cuts[w] : cuts[w + 1]].tolist())]
                        own = np.array([i for part in parts for i in part], np.int32)
                    self.known[word] = own.copy()
        return [self.known[word] for word in words]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        flat = flat[(keep := (flat >= 0) & (flat < len(self.lengths)))]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        lengths = self.lengths[flat]
        stops = np.cumsum(lengths)
        index = np.repeat(self.offsets[flat] - (stops - lengths), lengths) + np.arange(stops[-1] if len(stops) else 0)
        raw = self.spelled[index].tobytes()
        cuts = np.concatenate([[0], stops])[np.concatenate([[0], ends])]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=1)
def piece_table(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str = MODEL, most_known: int = KNOWN, with_decoded: bool = False) -> DataFrame:
    """docs with pieces, the piece ids of every whole text; ``with_decoded`` adds decoded, the text they spell, in the same pass.

    A null text has null pieces, an empty text none. A character without a piece becomes its bytes' pieces. Texts of
    any length are cut into words only, in parts of bounded size; a column named pieces is replaced, other columns stay
    whatever their names. Repeated rows give equal rows, an empty table an empty one. At most ``most_known`` words are
    sent to all tasks; the ids do not depend on it.
    """
    spark, table = docs.sparkSession, piece_table(model)
    kept = docs.drop("pieces", *(["decoded"] if with_decoded else []))
    frame = piece_frame(spark, table.rows)
    known = known_words(kept, frame, table.longest, table.byte_ids.tolist(), lambda: piece_table(model).cuts, most_known).toArrow()
    word, ids = known.column("word").combine_chunks().cast(pa.large_string()), known.column("ids").combine_chunks()
    sent = spark.sparkContext.broadcast((word, np.asarray(ids.flatten(), np.int32), np.asarray(ids.offsets, np.int64)))

    def words_as_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        table = piece_table(model)
        known, flat, borders = sent.value
        found, sizes = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for words, row in table.cuts.of_texts(texts):
            coded = words.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=known)
            rare = np.flatnonzero(np.asarray(place.is_null()))
            own = table.encode_words(coded.dictionary.take(pa.array(rare)).to_pylist())
            lengths = np.array([len(x) for x in own], np.int64)
            place = np.asarray(pc.fill_null(place, 0), np.int64)
            place[rare] = len(known) + np.arange(len(rare))
            first = np.concatenate([borders[:-1], len(flat) + np.cumsum(lengths) - lengths])
            last = np.concatenate([borders[1:], len(flat) + np.cumsum(lengths)])
            at = place[np.asarray(coded.indices, np.int64)]
            found.append(gather(np.concatenate([flat, *own]), first[at], last[at])[0].astype(np.int32))
            sizes += np.bincount(row, last[at] - first[at], len(texts)).astype(np.int64)
        return np.concatenate(found), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                column = part.column("text")
                flat, sizes = words_as_ids(column.to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                pieces = pa.ListArray.from_arrays(ends, pa.array(flat), mask=column.is_null())
                made = [pieces, spelled(pieces, piece_table(model))] if with_decoded else [pieces]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *["pieces", "decoded"][: len(made)]])

    added = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return add_columns(kept, run, added[: 1 + with_decoded])


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with decoded, the text that their pieces spell; null pieces give null.

    Control ids, null ids and ids outside the model spell nothing; bytes that are no UTF-8 become U+FFFD. The space that encoding puts
    before a text is taken off. A text comes back exactly unless it holds U+2581, which pieces use for the space. A column
    named decoded is replaced, other columns stay whatever their names. An empty table gives an empty one.
    """

    kept = encoded.drop("decoded")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, spelled(batch.column("pieces"), piece_table(model))], [*batch.schema.names, "decoded"])

    return add_columns(kept, by_parts(run), [T.StructField("decoded", T.StringType())])


def spelled(pieces: pa.Array, table: Pieces) -> pa.Array:
    """The text of every row of ids."""
    texts: list[str] = []
    for at in range(0, len(pieces), DECODED_ROWS):
        column = pieces.slice(at, DECODED_ROWS)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        texts += table.decode(np.asarray(pc.fill_null(column.flatten(), -1), np.int64), np.cumsum(sizes))
    return pa.array([None if null else t for t, null in zip(texts, pieces.is_null().to_pylist())], pa.string())
