"""The relational lattice: distinct words -> substrings -> equi-join to the piece table -> edges of a word -> fold.

A word is what remains of a text when it is cut between all neighbouring characters that stand together in no piece; no
piece crosses such a cut, so a word's pieces are the same wherever it occurs and are worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewise.functions.text import let
from citewise.llm.common import in_small_batches, slices
from citewise.llm.spans import larger_batches, strings
from citewise.plans.materialize import settle

SPACE = "▁"
LONGEST_WORD = 48  # characters of a word whose symbol borders fit the bits of one number
KNOWN = 1 << 17  # words that are folded once and sent to all tasks
AT_ONCE = 1 << 20  # bytes of text that a task holds as arrays
PART = 1 << 19  # characters of a long text that are cut at a time


class Cuts:
    """Where a text may be cut: between two characters that no piece holds side by side."""

    def __init__(self, pieces: list[str]):
        pairs = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:])}
        letters = sorted({ord(c) for pair in pairs for c in pair})
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[letters] = np.arange(1, len(letters) + 1)
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for a, b in pairs:
            self.joined[self.kind[ord(a)], self.kind[ord(b)]] = True

    def words(self, text: str, starts: list[int]) -> tuple[pa.Array, np.ndarray]:
        """(words, place of the first one that begins at each start); the text is cut at all starts."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = self.kind[codes]
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = ~self.joined[kinds[:-1], kinds[1:]]
        cut[starts] = True
        sizes = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        borders = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes, out=borders[1:])
        return strings(np.frombuffer(text.encode(), np.uint8), borders[cut]), np.cumsum(cut)[starts] - 1

    def of_texts(self, texts: list[str | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Words in parts, with the text each is from; a long text is cut in parts that end where a word does."""
        held, rows, size = [], [], 0
        for row, text in enumerate(texts):
            if not text:
                continue
            shown = SPACE + text.replace(" ", SPACE)
            if len(shown) > PART:
                for part in self.parts(shown):
                    words, _ = self.words(part, [0])
                    yield words, np.full(len(words), row)
                continue
            held.append(shown)
            rows.append(row)
            size += len(shown)
            if size > PART:
                yield self._several(held, rows)
                held, rows, size = [], [], 0
        if held:
            yield self._several(held, rows)

    def _several(self, held: list[str], rows: list[int]) -> tuple[pa.Array, np.ndarray]:
        starts = np.cumsum([0, *map(len, held)])[:-1]
        words, first = self.words("".join(held), starts)
        return words, np.repeat(rows, np.diff(np.append(first, len(words))))

    def parts(self, text: str) -> Iterator[str]:
        at, step = 0, PART
        while at < len(text):
            stop = at + step
            if stop >= len(text):
                yield text[at:]
                return
            kinds = self.kind[np.frombuffer(text[at : stop + 1].encode("utf-32-le"), np.uint32)]
            ends = np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]])
            if len(ends):
                yield text[at : at + int(ends[-1]) + 1]
                at, step = at + int(ends[-1]) + 1, PART
            else:  # one word, longer than a part
                step *= 2


def word_counts(texts: DataFrame, cuts) -> DataFrame:
    """(word, size, n) of all texts; ``cuts`` gives the Cuts in a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger_batches(batches, AT_ONCE):
            for part in slices(batch, "text", AT_ONCE):
                for words, _ in cuts().of_texts(part.column("text").to_pylist()):
                    found = words.value_counts()
                    word = found.field(0)
                    size = pc.utf8_length(word)
                    for some in pa.table({"word": word, "size": size.cast(pa.int32()), "n": found.field(1)}).to_batches(max_chunksize=50_000):
                        yield some.set_column(0, "word", some.column("word").cast(pa.string()))

    return in_small_batches(texts).select("text").mapInArrow(count, "word string, size int, n bigint").groupBy("word", "size").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = KNOWN) -> DataFrame:
    """Words so frequent that there are at most ``most`` of them; the limit is a count of occurrences, from a histogram."""
    short = counts.filter(F.col("size") <= LONGEST_WORD)
    height = F.floor(F.log2("n") * 8).cast("int")
    bars = short.groupBy(height.alias("height")).agg(F.count("*").alias("words")).collect()  # at most 8 x 64 rows
    least, words = None, 0
    for bar in sorted(bars, key=lambda b: -b["height"]):
        words += bar["words"]
        if words > most:
            break
        least = bar["height"]
    return short.filter(height >= least) if least is not None else short.filter(F.lit(False))


def edges(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, size, start, length, rank, id): every substring of a word that is a piece."""
    begun = words.select("word", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("start")))
    spelled = begun.select("word", "size", "start", F.explode(lengths).alias("length"))
    return spelled.withColumn("piece", F.expr("substring(word, start + 1, length)")).join(pieces, "piece").drop("piece")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def folded(lattice: DataFrame, byte_ids: list[int]) -> DataFrame:
    """(word, ids): the edges of each word folded into one segmentation.

    The state is a number whose bits are the starts of symbols. A step takes the best-ranked edge, leftmost first, that
    joins exactly two symbols; edges are sorted so, and a word has at most as many steps as borders inside. An edge
    brings its own bits: ``ends`` where it begins and ends, ``inner`` between them.
    """
    start, stop = F.col("start"), F.col("start") + F.col("length")
    masked = lattice.withColumn("ends", _bit(start).bitwiseOR(_bit(stop))).withColumn("inner", _bit(stop) - _bit(start + 1))
    join = F.when(F.col("length") > 1, F.struct("rank", "start", "ends", "inner"))
    spell = F.when(F.col("length") > 0, F.struct("ends", "id"))
    per_word = masked.groupBy("word", "size").agg(F.sort_array(F.collect_list(join)).alias("joins"), F.collect_list(spell).alias("spelled"))

    def step(state: Column, _: Column) -> Column:
        fits = F.filter("joins", lambda e: (F.bit_count(state.bitwiseAND(e["inner"])) == 1) & (state.bitwiseAND(e["ends"]) == e["ends"]))
        return F.coalesce(state.bitwiseAND(F.bitwise_not(F.get(fits, 0)["inner"])), state)

    everywhere = _bit(F.col("size") + 1) - 1
    steps = F.slice(F.sequence(F.lit(0), F.col("size")), F.lit(1), F.least(F.col("size") - 1, F.size("joins")))
    bytes_ = F.array(*[F.lit(i) for i in byte_ids])

    def ids(start: Column, stop: Column) -> Column:
        found = F.filter("spelled", lambda e: e["ends"] == _bit(start).bitwiseOR(_bit(stop)))
        raw = F.hex(F.encode(F.substring(F.col("word"), start + 1, stop - start), "utf-8"))
        places = F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))
        each = F.transform(places, lambda b: F.get(bytes_, F.conv(F.substring(raw, b * 2 + 1, F.lit(2)), 16, 10).cast("int")))
        return F.when(F.size(found) > 0, F.transform(found, lambda e: e["id"])).otherwise(each)

    def symbols(starts: Column) -> Column:
        return F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda start, at: ids(start, F.get(starts, at + 1)))

    # let: the fold is worked out once, not once for every place that its result is compared with
    starts = let(F.aggregate(steps, everywhere, step), lambda state: F.filter(F.sequence(F.lit(0), F.col("size")), lambda i: state.bitwiseAND(_bit(i)) != 0))
    return per_word.select("word", F.flatten(let(starts, symbols)).alias("ids"))


def known_words(texts: DataFrame, pieces: DataFrame, longest: int, byte_ids: list[int], cuts, most: int = KNOWN) -> DataFrame:
    """(word, ids) of the frequent words of all texts, by way of the lattice; at most ``most`` rows."""
    words = settle(frequent_words(settle(word_counts(texts, cuts)), most).select("word", "size"))
    found = edges(words, pieces, longest)
    whole = found.unionByName(words.select("word", "size", *[F.lit(0).cast("int").alias(c) for c in ("start", "length", "rank", "id")]))
    return folded(whole, byte_ids)


def piece_frame(spark: SparkSession, rows: list[tuple[str, int, int]]) -> DataFrame:
    """(piece, rank, id) of the model's table."""
    pieces, ranks, ids = zip(*rows)
    return spark.createDataFrame(pa.table({"piece": pa.array(pieces), "rank": pa.array(ranks, pa.int32()), "id": pa.array(ids, pa.int32())}))
