"""Phrase collocations by prefix-free parsing: texts become overlapping chunks cut where the content says so; equal
chunks are one dictionary entry with its frequency; phrases are counted inside distinct chunks only, by weight.

A chunk begins at every word pair whose hash falls on a trigger and reaches two words into the next chunk of its piece.
It owns the phrases that begin before the next chunk's start, so a phrase in the overlap counts once. Chunks do not
cross pieces. Equal passages give equal chunks wherever they stand, which is where the dictionary saves work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewise.llm.common import slices, text_bytes
from citewise.llm.shingles import mixed, powers, prefix_sums
from citewise.llm.spans import LOWER, byte_class, gather, larger_batches, segments, strings, word_spans
from citewise.plans.materialize import settle

BREAK = byte_class((0x0A, 0x0D)) | np.isin(np.arange(256), list(b".,;:!?"))
BLANK = byte_class((0x09, 0x09), (0x20, 0x20))
LONGEST = 3  # words of a phrase
OVERLAP = LONGEST - 1
EVERY = 8  # a word pair in so many begins a chunk
STRETCH = 4096  # words after which a chunk without a trigger is cut
AT_ONCE = 3_500_000  # bytes of text or of chunks that a task holds as arrays
ROWS_AT_ONCE = 50_000
KEYS_AT_ONCE = 1 << 21  # words and pairs in a bucket
PACKED_BYTES = 2 << 20
BANDS = 64  # bands of scores for every doubling
SIEVE_BITS = 1 << 27  # the largest sieve, 16 MB
PAIR = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0x9FB21C651E98DF25], np.uint64)


def hashes(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A hash of every word of a buffer in which each word is followed by one more byte."""
    sums = prefix_sums(data)
    _, down = powers(len(data))
    first, last = borders[:-1], borders[1:] - 1
    return mixed((sums[last] - sums[first]) * down[first])


def phrase_hashes(words: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    joined = words[at] * PAIR[0]
    for i in range(1, size):
        joined = joined + words[at + i] * PAIR[i]
    return mixed(joined) if size > 1 else words[at]


def _chunks(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(bytes of all chunks, their borders, the words that each owns, the text that each is from)."""
    raw = LOWER[raw]
    breaks = BREAK[raw]
    first, last = word_spans(~(breaks | BLANK[raw]), starts)
    if not len(first):
        return None
    data, borders = gather(raw, first, last, 1)
    data[borders[1:] - 1] = 32
    text = np.searchsorted(starts, first, side="right") - 1
    piece = np.cumsum(breaks, dtype=np.int32)[first]
    begins = np.ones(len(first) + 1, bool)
    begins[1:-1] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    ends = np.flatnonzero(begins)  # starts of pieces and the end
    words = hashes(data, borders)
    starts_here = begins[:-1].copy()
    if len(first) > 1:
        pairs = phrase_hashes(words, 2, np.arange(len(first) - 1))
        starts_here[:-1] |= (pairs % np.uint64(EVERY) == 0) & ~begins[1:-1]
    opened = np.flatnonzero(starts_here)
    closed = np.append(opened[1:], len(first))
    parts = np.maximum((closed - opened + STRETCH - 1) // STRETCH, 1)
    if parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        opened = np.repeat(opened, parts) + step * STRETCH
        closed = np.append(opened[1:], len(first))
    limit = ends[np.searchsorted(ends, opened, side="right")]
    reach = np.minimum(closed + OVERLAP, limit)
    chunk, edges = gather(data, borders[opened], borders[reach] - 1)
    return chunk, edges, closed - opened, text[opened]


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, own, n): every distinct chunk of every language, the words that it owns and how often it occurs."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger_batches(batches, AT_ONCE):
            for part in slices(batch, "text", AT_ONCE):
                raw, starts, ends = text_bytes(part.column("text"))
                whole = [(raw, starts, np.arange(len(starts)))]
                for piece, begun, rows in whole if len(raw) <= AT_ONCE else segments(raw, starts, ends, BREAK, AT_ONCE):
                    found = _chunks(piece, begun)
                    if found is not None:
                        chunk, edges, own, text = found
                        lang = part.column("lang").dictionary_encode().take(pa.array(rows[text]))
                        yield from counted(lang, strings(chunk, edges), own)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parsed = texts.mapInArrow(parse, "lang string, chunk string, own int, n bigint")
    return settle(parsed.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")))


def counted(lang: pa.Array, text: pa.Array, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one batch with the same language, chunk and own words as one, with their number."""
    langs, texts = lang.dictionary_encode(), text.dictionary_encode()
    most = int(own.max()) + 1 if len(own) else 1
    lang, text = np.asarray(langs.indices, np.int64), np.asarray(texts.indices, np.int64)
    heads, n = added((lang * max(len(texts.dictionary), 1) + text) * most + own, np.ones(len(own), np.int64))
    for at in range(0, len(heads), ROWS_AT_ONCE):
        some = heads[at : at + ROWS_AT_ONCE]
        out = {"lang": langs.dictionary.take(pa.array(lang[some])), "chunk": texts.dictionary.take(pa.array(text[some])).cast(pa.string())}
        yield pa.record_batch({**out, "own": own[some].astype(np.int32), "n": n[at : at + ROWS_AT_ONCE]})


class Words:
    """The words of a batch of chunks, one after the other, with what their chunks say of them."""

    def __init__(self, batch: pa.RecordBatch):
        raw, _, ends = text_bytes(batch.column("chunk"))
        self.data = np.insert(raw, ends, 32)  # now every word has one blank behind it
        blanks = np.flatnonzero(self.data == 32)
        self.borders = np.append(0, blanks + 1)
        closed = np.searchsorted(blanks, ends + np.arange(len(ends)), side="right")
        held = np.diff(closed, prepend=0)
        self.lang, self.n = batch.column("lang").dictionary_encode(), np.asarray(batch.column("n"), np.int64)
        self.chunk = np.repeat(np.arange(len(ends)), held)
        place = np.arange(len(blanks)) - np.repeat(closed - held, held)
        self.left = np.repeat(held, held) - place  # words of the chunk from this one on
        self.owned = place < np.repeat(np.asarray(batch.column("own"), np.int64), held)

    def keys(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words of all phrases of so many words, hashes of the language and the phrase)."""
        at = np.flatnonzero(self.left >= size)
        return at, mixed(phrase_hashes(self.hashes, size, at) ^ self.spread[at])

    @cached_property
    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.borders)

    @cached_property
    def spread(self) -> np.ndarray:
        known = [int.from_bytes(blake2b(lang.encode(), digest_size=8).digest()) for lang in self.lang.dictionary.to_pylist()]
        return np.array(known, np.uint64)[np.asarray(self.lang.indices)][self.chunk]

    def phrases(self, size: int, at: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
        """The phrases of so many words from these words on, equal ones as one, packed by bucket and language."""
        if not len(at):
            return
        phrase, edges = gather(self.data, self.borders[at], self.borders[at + size] - 1)
        lang = np.asarray(self.lang.indices, np.int64)[self.chunk[at]]
        heads, sums = grouped(lang, strings(phrase, edges).dictionary_encode(), self.n[self.chunk[at]])
        at, lang, place = at[heads], lang[heads], bucket_of(keys[heads], buckets)
        order = np.lexsort((lang, place))
        at, lang, place = at[order], lang[order], place[order]
        phrase, edges = gather(self.data, self.borders[at], self.borders[at + size])
        phrase[edges[1:] - 1] = 10  # no phrase holds a line break
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (lang[1:] != lang[:-1])]))
        langs = self.lang.dictionary.take(pa.array(lang[first]))
        ends = np.append(first, len(at))
        yield from packed({"bucket": place[first].astype(np.int32), "lang": langs, "phrases": blobs(phrase, edges[ends]), "n": blobs(sums[order], 8 * ends)})


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket, out of a power of two, by the leading bits of a key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def buckets_for(words: int) -> int:
    """Buckets for phrases of a dictionary with so many words: a task holds those of one, about KEYS_AT_ONCE words and pairs at most."""
    return 1 << max(5, (2 * words // KEYS_AT_ONCE).bit_length())


def blobs(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """The bytes of an array between the borders as binary values."""
    data = np.ascontiguousarray(values).view(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The arrays of all values of a binary column one after the other."""
    return np.concatenate([np.frombuffer(value.as_buffer(), kind) for value in column])


def packed(columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows of packed arrays, about PACKED_BYTES at a time."""
    batch = pa.record_batch(columns)
    step = max(1, batch.num_rows * PACKED_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def grouped(lang: np.ndarray, text: pa.DictionaryArray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of every language and text, their n added)."""
    return added(lang * max(len(text.dictionary), 1) + np.asarray(text.indices, np.int64), n)


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of every key in the order of keys, their n added)."""
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return order[heads], np.add.reduceat(n[order], heads) if len(heads) else n


def likely_keys(chunks: DataFrame, least: int, buckets: int) -> DataFrame:
    """(key): hashes under which words and pairs of one language occur at least so often, those of all frequent ones among them.

    What shares a hash only adds to its count, so no frequent word or pair is missed; a few others may be held too.
    Hashes travel packed by bucket, as a row for each would cost more than its count.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger_batches(batches, AT_ONCE):
            words = Words(batch)
            found, weights = [], []
            for size in range(1, LONGEST):
                at, keys = words.keys(size)
                own = words.owned[at]
                found.append(keys[own])
                weights.append(words.n[words.chunk[at[own]]])
            keys, n = np.concatenate(found), np.concatenate(weights)
            heads, sums = added(keys, n)
            keys, place = keys[heads], bucket_of(keys[heads], buckets)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
            ends = 8 * np.append(first, len(keys))
            yield from packed({"bucket": place[first].astype(np.int32), "keys": blobs(keys, ends), "n": blobs(sums, ends)})

    def add(rows: pa.Table) -> pa.Table:
        keys = unpacked(rows.column("keys"), np.int64)
        heads, sums = added(keys, unpacked(rows.column("n"), np.int64))
        return pa.table({"key": keys[heads[sums >= least]]})

    return settle(chunks.mapInArrow(weigh, "bucket int, keys binary, n binary").groupBy("bucket").applyInArrow(add, "key bigint"))


def phrase_counts(chunks: DataFrame, sieve: Callable[[], np.ndarray], least: int, buckets: int) -> DataFrame:
    """(lang, phrase, n) of phrases of one to three words that occur at least so often, counted in the dictionary's chunks by weight.

    Words and pairs are counted only if they pass the sieve, triples only if both their pairs do. A sieve lets some
    others pass too, and never holds back a phrase that is in it. Phrases travel packed by bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve()
        for batch in larger_batches(batches, AT_ONCE):
            words = Words(batch)
            known = np.zeros(len(words.left) + 1, bool)
            for size in range(1, LONGEST):
                at, keys = words.keys(size)
                some = passes(bits, keys)
                known[:] = False
                known[at[some]] = True
                some &= words.owned[at]
                yield from words.phrases(size, at[some], keys[some], buckets)
            at, keys = words.keys(LONGEST)
            some = words.owned[at] & known[at] & known[at + 1]
            yield from words.phrases(LONGEST, at[some], keys[some], buckets)

    def add(rows: pa.Table) -> pa.Table:
        data = unpacked(rows.column("phrases"), np.uint8)
        borders = np.append(0, np.flatnonzero(data == 10) + 1)
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        lang = np.repeat(np.asarray(langs.indices, np.int64), [len(n) // 8 for n in (value.as_buffer() for value in rows.column("n"))])
        heads, sums = grouped(lang, strings(data, borders).dictionary_encode(), unpacked(rows.column("n"), np.int64))
        heads, sums = heads[sums >= least], sums[sums >= least]
        phrase = strings(*gather(data, borders[heads], borders[heads + 1] - 1)).cast(pa.string())
        return pa.table({"lang": langs.dictionary.take(pa.array(lang[heads])), "phrase": phrase, "n": sums})

    found = chunks.mapInArrow(count, "bucket int, lang string, phrases binary, n binary")
    return found.groupBy("bucket").applyInArrow(add, "lang string, phrase string, n bigint")


def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64(bits - 1), (keys >> np.uint64(33)) & np.uint64(bits - 1)


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the sieve."""
    found = np.ones(len(keys), bool)
    for place in places(keys, len(words) * 64):
        found &= (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def build_sieve(keys: DataFrame) -> Callable[[], np.ndarray]:
    """A Bloom filter of keys: 16 to 32 bits a key, and 16 MB at most however many there are.

    Beyond that bound it lets more phrases pass and saves less; counts stay exact, as what passes is counted anyway.
    """
    spark = keys.sparkSession
    bits = min(SIEVE_BITS, 1 << max(16, (16 * keys.count()).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger_batches(batches, AT_ONCE):
            place = np.concatenate(places(np.asarray(batch.column("key"), np.int64).view(np.uint64), bits))
            order = np.argsort(place >> np.uint64(6), kind="stable")
            block, mask = (place >> np.uint64(6))[order], np.uint64(1) << (place & np.uint64(63))[order]
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            yield pa.record_batch({"block": block[heads].astype(np.int64), "mask": np.bitwise_or.reduceat(mask, heads).view(np.int64)})

    marked = keys.mapInArrow(mark, "block bigint, mask bigint").groupBy("block").agg(F.bit_or("mask").alias("mask"))
    table = marked.toArrow()  # at most SIEVE_BITS / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[np.asarray(table.column("block"), np.int64)] = np.asarray(table.column("mask"), np.int64).view(np.uint64)
    sent = spark.sparkContext.broadcast(words)
    return lambda: sent.value


def score(a: str, left: str, right: str) -> str:
    """floor(1000000 * a * a / (left * right)) in whole decimals, as products may pass 64 bits."""
    return f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))"


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, inside_percent: int = 50) -> DataFrame:
    """The first phrases of every language by score: lang, rank, phrase, a, l, r, n, score.

    docs(text, lang): a null text has no words, a null lang is "und"; every row counts, repeated ones too. A-Z are
    lower-cased, texts fall into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs. Phrases of
    two or three words with at least ``least`` occurrences are scored by their weakest cut, the earlier on a tie, and
    left out if a longer such phrase holds them in at least inside_percent of their occurrences. Equal scores stand by
    occurrences, then by the phrase in byte order. A piece without a trigger is cut every 4,096 words, so a text of any
    length is parsed in bounded parts unless a single piece is longer. Other columns are not read, whatever their
    names. An empty table gives an empty result.
    """
    chunks = dictionary(docs)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    buckets = buckets_for(chunks.agg(F.sum("own")).first()[0] or 0)
    counts = settle(phrase_counts(chunks, build_sieve(likely_keys(chunks, least, buckets)), least, buckets))
    word = F.split("phrase", " ")
    frequent, pairs, triples = (counts.filter(F.size(word) == size) for size in (1, 2, 3))

    left2, right2 = F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " ")
    inside = triples.select("lang", F.explode(F.array(left2, right2)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))

    def part(counts: DataFrame, name: str, value: str) -> DataFrame:
        return counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))

    two = pairs.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("n")))
    two = two.select("lang", "phrase", F.col("n").alias("a"), word[0].alias("w1"), word[1].alias("w2"))
    two = two.join(part(frequent, "w1", "l"), ["lang", "w1"]).join(part(frequent, "w2", "r"), ["lang", "w2"])
    two = two.select("lang", "phrase", "a", "l", "r", F.expr(score("a", "l", "r")).alias("score"))

    three = triples.select("lang", "phrase", F.col("n").alias("a"), word[0].alias("w1"), right2.alias("p2"), left2.alias("p1"), word[2].alias("w3"))
    for counts, name, value in ((frequent, "w1", "l1"), (pairs, "p2", "r1"), (pairs, "p1", "l2"), (frequent, "w3", "r2")):
        three = three.join(part(counts, name, value), ["lang", name])
    three = three.withColumn("s1", F.expr(score("a", "l1", "r1"))).withColumn("s2", F.expr(score("a", "l2", "r2")))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", "phrase", "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    ranked = first_by_score(settle(two.unionByName(three)), first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def first_by_score(scored: DataFrame, first: int) -> DataFrame:
    """The first rows of every language with their rank, by score, occurrences and phrase.

    Counts by band of scores tell below which band no row can be among the first; the rest is cut to the first of every
    part of a language before the parts are ranked together, so no task ranks a whole language.
    """
    banded = scored.withColumn("band", F.floor(F.log2(F.col("score") + 1) * BANDS).cast("int"))
    bands = banded.groupBy("lang", "band").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("lang").orderBy(F.desc("band"))
    above = bands.withColumn("above", F.sum("rows").over(down) - F.col("rows")).filter(F.col("above") < first)
    least = settle(above.groupBy("lang").agg(F.min("band").alias("least")))
    order = (F.desc("score"), F.desc("a"), "phrase")
    near = banded.join(least, "lang").filter(F.col("band") >= F.col("least")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    part = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    whole = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return whole.filter(F.col("rank") <= first)
