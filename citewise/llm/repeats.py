"""Suffix-array dedup: maximal repeats from interval trees over enhanced suffix arrays, and removal of repeated bytes.

A corpus has no suffix array that fits a task, so suffixes are dealt by an anchor: in every 50 bytes the position of the
smallest 16-byte gram hash is chosen, and equal 50-byte strings choose the same one. Only anchors that occur in different texts go on, each
with its context, the bytes of all 50-byte strings that chose it. The contexts of an anchor form a small suffix array.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.llm.common import column, free_names, in_small_batches, map_batches, text_bytes
from citewise.llm.shingles import mixed, powers, prefix_sums
from citewise.plans.batches import slices
from citewise.plans.materialize import SETTLED, discard, parts_for, settle, settle_alone

LENGTH = 50
GRAM = 16
SPLIT = 4096  # contexts of an anchor that one task orders; more are grouped string by string
PART_BYTES = 8 << 20  # of text whose rows make up a file
PART_ROWS = 1 << 16  # contexts that make up a file
PLACE = np.uint64((1 << 24) - 1)
UNIT = 1 << 19  # anchors whose keys travel together
BUCKET = 1 << 20  # keys that meet in a bucket
AT_ONCE = 1 << 18  # bytes of text whose anchors are looked for together
LOW = np.uint64(24)  # lowest bits of a key that stay behind; keys equal in the others make an anchor a candidate only
WIDEST = 2 * (LENGTH - GRAM) + GRAM  # bytes of a context at most
ROUND = 0.4  # of the bytes of the texts that the contexts of one round take at most, as far as hashes deal them evenly
ROUND_LEAST = 64 << 20


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, document, place, first, stop) of every anchor: its context is raw[first:stop]; all in the order of the bytes."""
    empty = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(raw) < LENGTH or len(raw) > int(PLACE):
        return empty if len(raw) < LENGTH else _anchors_long(raw, starts, ends)
    sums, (_, down) = prefix_sums(raw), powers(len(raw))
    n = len(raw) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:n]) * down[:n])
    low = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    place = (low & PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    begin = np.flatnonzero(np.arange(len(place)) + LENGTH <= ends[owner[: len(place)]])
    if not len(begin):
        return empty
    place, doc = place[begin], owner[begin]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(begin)]]) - 1
    return grams[place[at]], doc[at], place[at], begin[at], begin[last] + LENGTH


def _anchors_long(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """A single text beyond the packed positions, in overlapping parts; an anchor cut by a border appears in both parts."""
    found, step = [], 1 << 22
    for at in range(0, len(raw) - LENGTH + 1, step):
        part = raw[at : at + step + LENGTH - 1]
        hashes, doc, place, first, stop = anchors(part, np.zeros(1, np.int64), np.array([len(part)]))
        found.append((hashes, doc, place + at, first + at, stop + at))
    return tuple(np.concatenate(c) for c in zip(*found))


def _prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    apart = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (apart.bit_length() + 7) // 8


def interval_tree(strings: list[bytes], least: int) -> Iterator[tuple[int, list[int]]]:
    """(common prefix, members) of every interval of the enhanced suffix array with a prefix of at least ``least``.

    One scan over the sorted strings with a stack of open intervals; an interval closes where the common prefix falls.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        shared = _prefix(strings[order[i - 1]], strings[order[i]]) if i < len(order) else -1
        left = i - 1
        while stack and stack[-1][0] > shared:
            depth, left = stack.pop()
            yield depth, order[left:i]
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, left))


def maximal_groups(contexts: list[tuple[bytes, bytes]], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of every maximal repeat of at least ``length`` bytes around an anchor.

    contexts: the bytes before the anchor, reversed, and those from it on. Intervals of the right sides cannot be
    extended to the right; inside one, intervals of the left sides have different bytes further left. A group that
    lies in a deeper right interval is left to that one.
    """
    rights = [right for _, right in contexts]
    longest = max(len(left) for left, _ in contexts)
    for right, members in interval_tree(rights, max(GRAM, length - longest)):
        lefts = [contexts[m][0] for m in members]
        for left, inner in interval_tree(lefts, max(0, length - right)):
            group = [members[i] for i in inner]
            if len(group) < len(members):
                low, high = min(group, key=rights.__getitem__), max(group, key=rights.__getitem__)
                if _prefix(rights[low], rights[high]) > right:
                    continue
            yield left, right, group


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones become one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id as bigint, text, and sha, the hash that tells texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.sha2(F.encode(text, "UTF-8"), 256).alias("sha"))


def _windows(raw: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size`` bytes from every place on; size is a multiple of eight."""
    words = np.lib.stride_tricks.sliding_window_view(raw, size)[at].view(np.uint64)
    h = np.full(len(at), size, np.uint64)
    for i in range(words.shape[1]):
        h = mixed(h + words[:, i])
    return h


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; equal bytes of neighbouring values lie side by side."""
    raw = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, *types) -> list[np.ndarray]:
    head = np.frombuffer(data, np.int64, 1 + len(types)).tolist()
    raw, at, out = pa.decompress(data[8 * (1 + len(types)) :], head[0], codec="zstd", asbytes=True), 0, []
    for kind, n in zip(types, head[1:]):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of every run of equal values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(values)))


def _rows_by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after the other from rows sorted by it."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if rows:
                    yield now, rows
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, rows


def _sent_keys(buckets: int):
    """(k, unit, told, data): keys of the anchors of about UNIT of them in one row for every bucket, and a row that tells their documents.

    A 50-byte string holds 16 bytes before its anchor or 16 behind it, so an anchor has one key for each side that its
    context has. Of keys that a unit shows in different documents one entry is sent, and all their anchors are told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                raw, starts, ends = text_bytes(part.column("text"))
                _, doc, place, first, stop = anchors(raw, starts, ends)
                before, after = np.flatnonzero(place - first >= GRAM), np.flatnonzero(stop - place >= 2 * GRAM)
                if not len(place):
                    continue
                keys = np.concatenate([_windows(raw, place[before] - GRAM, 2 * GRAM), ~_windows(raw, place[after], 2 * GRAM)])
                ids, labels = (np.asarray(part.column(c), np.int64) for c in ("doc_id", "label"))
                held.append((ids, labels, np.bincount(doc, minlength=len(ids)), keys >> LOW, (np.concatenate([before, after]) + size).astype(np.int32)))
                size += len(place)
                if size >= UNIT:
                    yield _unit(held, count, buckets)
                    held, size, count = [], 0, count + 1
        if held:
            yield _unit(held, count, buckets)

    return run


def _unit(held: list[tuple], unit: int, buckets: int) -> pa.RecordBatch:
    ids, labels, counts, keys, anchor = (np.concatenate(c) for c in zip(*held))
    held.clear()
    order = np.argsort(keys)
    keys, anchor = keys[order], anchor[order]
    first, run = _runs(keys)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[anchor]
    known = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), run)
    sent = ~known
    sent[first] = True
    told = np.unique(anchor[known])
    keys, entry = keys[sent], 2 * anchor[sent].astype(np.uint64) + known[sent]
    bucket = ((keys >> np.uint64(64 - 32) - LOW) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.append(_runs(bucket)[0], len(bucket)).tolist()
    rows = [(-1 - unit % buckets, unit, True, _packed(ids, labels, counts, np.diff(told.astype(np.int64), prepend=0)))]
    for a, b in zip(edges[:-1], edges[1:]):
        rows.append((int(bucket[a]), unit, False, _packed(np.diff(keys[a:b], prepend=np.uint64(0)), entry[a:b])))
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["k", "unit", "told", "data"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, told, data): anchors of a unit with a key that another unit has or that is known to be shared; rows that tell go through."""
    for k, rows in _rows_by(batches, "k"):
        if k < 0:
            out = [(r["unit"], True, r["data"]) for r in rows]
        else:
            parts = [_unpacked(r["data"], np.uint64, np.uint64) for r in rows]
            keys, entry = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
            of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
            del parts
            order = np.argsort(keys)
            first, run = _runs(keys[order])
            entry, of = entry[order], of[order]
            shared = np.minimum.reduceat(of, first) < np.maximum.reduceat(of, first)
            shared = np.repeat(shared | (np.maximum.reduceat(entry & np.uint64(1), first) > 0), run)
            entry, of = entry[shared] >> np.uint64(1), of[shared]
            order = np.lexsort((entry, of))
            edges = np.searchsorted(of[order], np.arange(len(rows) + 1))
            entry = entry[order]
            out = [
                (rows[i]["unit"], False, _packed(np.diff(entry[a:b], prepend=np.uint64(0))))
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if a < b
            ]
        if out:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["unit", "told", "data"])


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, picks): numbers of the shared anchors of every document that has any, in the order of its bytes."""
    for _, rows in _rows_by(batches, "unit"):
        ids, labels, counts, told = next(_unpacked(r["data"], np.int64, np.int64, np.int64, np.int64) for r in rows if r["told"])
        others = [np.cumsum(_unpacked(r["data"], np.uint64)[0]).astype(np.int64) for r in rows if not r["told"]]
        anchor = np.unique(np.concatenate([np.cumsum(told), *others]))
        if not len(anchor):
            continue
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, anchor, side="right")
        first, _ = _runs(doc)
        picks = (anchor - (ends - counts)[doc]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(picks))
        yield pa.RecordBatch.from_arrays([pa.array(ids[doc[first]]), pa.array(labels[doc[first]]), lists], ["doc_id", "label", "picks"])


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, sha, n_bytes) of every row, (sha, first, n_bytes) of every text, first being its smallest doc_id, and the bytes of all."""
    rows = settle(_identified(docs).select("doc_id", "sha", F.octet_length("text").cast("bigint").alias("n_bytes")))
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    texts = rows.filter(F.col("doc_id").isNotNull()).groupBy("sha").agg(F.min("doc_id").alias("first"), F.first("n_bytes").alias("n_bytes"))
    return rows, settle(texts, parts_for(docs.sparkSession, size, PART_BYTES)), size


def _first_copies(docs: DataFrame, rows: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, label, text) of the first copy of every text of 50 bytes and more, and their bytes; label tells texts apart."""
    own = _identified(docs).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).select("doc_id", F.xxhash64("sha").alias("label"), "text")
    texts, rows = texts.filter(F.col("n_bytes") >= LENGTH), rows.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= LENGTH))
    n_texts, size = texts.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    if (n_rows := rows.count()) > n_texts:
        kept = own.join(texts.select(F.col("first").alias("doc_id"), F.xxhash64("sha").alias("label")), ["doc_id", "label"], "left_semi")
        again = n_rows > rows.select("doc_id", "sha").distinct().count()
        own = settle(kept.dropDuplicates(["doc_id", "label"]) if again else kept, parts_for(docs.sparkSession, size, PART_BYTES))
    return own, size or 0


def _marked(docs: DataFrame, rows: DataFrame, texts: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int, int]:
    """(doc_id, label, text, spots) of the texts with shared anchors, the number of rounds and the files for what one round finds.

    A spot is the place of a shared anchor, the bytes of its context before it and in all, and the round that judges it.
    Contexts take several times the bytes of their texts where all is shared, so a round holds those of ROUND of the bytes.
    """
    own, size = _first_copies(docs, rows, texts)
    buckets = parts_for(docs.sparkSession, size // 9, BUCKET)
    sent = in_small_batches(own.select("doc_id", "label", "text")).mapInArrow(_sent_keys(buckets), "k int, unit bigint, told boolean, data binary")
    shared = sent.repartition(buckets, "k").sortWithinPartitions("k").mapInArrow(_shared_keys, "unit bigint, told boolean, data binary")
    picked = shared.repartition("unit").sortWithinPartitions("unit").mapInArrow(_picked, "doc_id bigint, label bigint, picks array<int>")
    files = parts_for(docs.sparkSession, size, PART_BYTES)
    picked = settle(picked, files)
    n = picked.agg(F.sum(F.size("picks"))).first()[0] or 0
    rounds = rounds or min(256, max(1, math.ceil(n * WIDEST / max(ROUND * size, ROUND_LEAST))))

    def mark(part: pa.RecordBatch) -> pa.RecordBatch:
        raw, starts, ends = text_bytes(part.column("text"))
        _, doc, place, first, stop = anchors(raw, starts, ends)
        picks = part.column("picks")
        lengths = np.asarray(pc.list_value_length(picks), np.int64)
        at = np.asarray(picks.flatten(), np.int64) + np.repeat(np.searchsorted(doc, np.arange(len(starts))), lengths)
        place, first, stop, doc = place[at], first[at], stop[at], doc[at]
        turn = (_windows(raw, place, GRAM) >> np.uint64(32)) * np.uint64(rounds) >> np.uint64(32)
        spots = (place - starts[doc]) << 24 | (place - first) << 16 | (stop - first) << 8 | turn.astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(spots))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "text")), lists], ["doc_id", "label", "text", "spots"])

    joined = own.join(picked, ["doc_id", "label"]).select("doc_id", "label", "text", "picks")
    marked = map_batches(joined, mark, "doc_id bigint, label bigint, text string, spots array<bigint>", "text", AT_ONCE)
    if rounds > 1:
        marked = settle(marked, files)
        discard(picked)
        if hasattr(own, SETTLED):
            discard(own)
    return marked, rounds, parts_for(docs.sparkSession, n // rounds, PART_ROWS)


def _contexts_of(marked: DataFrame, turn: int) -> DataFrame:
    """(h, at, ctx, who): the contexts that one round judges, the anchor being ctx[at:]; who lists doc_id, label and first byte
    of every occurrence. Equal contexts of a batch are one row, so a passage of very many documents is sent a few times only."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, starts, _ = text_bytes(part.column("text"))
        flat = part.column("spots")
        doc = np.repeat(np.arange(len(starts)), np.asarray(pc.list_value_length(flat), np.int64))
        spots = np.asarray(flat.flatten(), np.int64)
        mine = np.flatnonzero(spots & 255 == turn)
        if not len(mine):
            return None
        doc, spots = doc[mine], spots[mine]
        place, at = starts[doc] + (spots >> 24), spots >> 16 & 255
        begin = place - at
        stop, whole, seen = begin + (spots >> 8 & 255), raw.tobytes(), {}
        keys = [(whole[a:b], c) for a, b, c in zip(begin.tolist(), stop.tolist(), at.tolist())]
        same = np.array([seen.setdefault(key, i) for i, key in enumerate(keys)])
        order = np.argsort(same, kind="stable")
        edges, _ = _runs(same[order])
        heads = order[edges]
        ids, labels = (np.asarray(part.column(c), np.int64)[doc] for c in ("doc_id", "label"))
        who = np.stack([ids, labels, begin - starts[doc]], axis=1)[order].ravel()
        columns = [
            pa.array(_windows(raw, place[heads], GRAM).view(np.int64)), pa.array(at[heads].astype(np.int32)),
            pa.array([keys[i][0] for i in heads.tolist()], pa.binary()),
            pa.ListArray.from_arrays(pa.array(3 * np.append(edges, len(same)), pa.int32()), pa.array(who)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["h", "at", "ctx", "who"])

    return map_batches(marked, cut, "h bigint, at int, ctx binary, who array<bigint>", "text", 4 << 20)


def _occurrences(found: DataFrame, *kept: str) -> DataFrame:
    """doc_id, label, start and the kept columns of every occurrence of a context; cid tells the contexts of an anchor apart."""
    one = lambda i: F.struct(*[F.get("who", i * 3 + j).alias(c) for j, c in enumerate(("doc_id", "label", "start"))])
    listed = F.transform(F.sequence(F.lit(0), (F.size("who") / 3).cast("int") - 1), one)
    return found.select(*kept, F.xxhash64("ctx", "at").alias("cid"), F.explode(listed).alias("one")).select(*kept, "cid", "one.*")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (h, cid, ctx, at, doc) of one anchor after the other from rows sorted by h."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "cid", "ctx", "at", "doc"))):
            if row[0] != key:
                if len(rows) > 1:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row)
    if len(rows) > 1:
        yield key, rows


def _distinct_contexts(found: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Distinct contexts with their smallest doc_id: those of anchors that a task can order, and those of all others."""
    sizes = found.groupBy("h", "cid").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes.filter(F.col("n") > SPLIT).select("h"), parts)
    unique = lambda rows: rows.groupBy("h", "cid").agg(F.min("doc_id").alias("doc"), F.first("at").alias("at"), F.first("ctx").alias("ctx"))
    return unique(found.join(sizes, "h", "left_anti")), unique(found.join(sizes, "h", "left_semi"))


def _ordered(unique: DataFrame) -> DataFrame:
    """Rows of an anchor side by side."""
    return unique.select("h", "cid", "ctx", "at", "doc").repartition("h").sortWithinPartitions("h")


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, start): every maximal repeat of at least 50 bytes between different texts, with all its occurrences
    in the first copy of each text; occurrences in further exact copies are not listed.

    A repeat is maximal within the contexts of its anchor, so a long one is reported as a chain of overlapping ones.
    Anchors with more than SPLIT distinct contexts report every shared string of 50 bytes instead.
    """
    rows, texts, _ = _rows(docs)
    marked, _, parts = _marked(docs, rows, texts, 1)
    found = settle(_occurrences(_contexts_of(marked, 0), "h", "ctx", "at"), parts)
    small, large = _distinct_contexts(found, parts)

    def groups(batches):
        for _, rows in _grouped(batches):
            sides = [(ctx[:at][::-1], ctx[at:]) for _, _, ctx, at, _ in rows]
            out: list[tuple] = []
            for left, right, members in maximal_groups(sides):
                _, _, ctx, at, _ = rows[members[0]]
                name = hashlib.blake2b(ctx[at - left : at + right], digest_size=8).hexdigest()
                out += [(name, left + right, rows[m][0], rows[m][1], rows[m][3] - left) for m in members]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["repeat", "length", "h", "cid", "shift"])

    named = _ordered(small).mapInArrow(groups, "repeat string, length bigint, h bigint, cid bigint, shift bigint")
    strings = _strings(large)
    varied = strings.groupBy("string").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a < b").select("string")
    split = strings.join(varied, "string").select(F.hex("string").alias("repeat"), F.lit(LENGTH).cast("bigint").alias("length"), "h", "cid", F.col("shift").cast("bigint").alias("shift"))
    return named.unionAll(split).join(found, ["h", "cid"]).select("repeat", "length", "doc_id", (F.col("start") + F.col("shift")).cast("int").alias("start"))


def _strings(large: DataFrame) -> DataFrame:
    """(string, h, cid, shift, doc): every string of 50 bytes of the contexts, as a 128-bit hash."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for h, cid, ctx, doc in zip(*(batch.column(c).to_pylist() for c in ("h", "cid", "ctx", "doc"))):
            for shift in range(len(ctx) - LENGTH + 1):
                for column, value in zip(out, (hashlib.blake2b(ctx[shift : shift + LENGTH], digest_size=16).digest(), h, cid, shift, doc)):
                    column.append(value)
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["string", "h", "cid", "shift", "doc"])

    return map_batches(large.select("h", "cid", "ctx", "doc"), cut, "string binary, h bigint, cid bigint, shift int, doc bigint")


def _judged_anchors(split: int):
    """(doc_id, label, a, b) of the repeated bytes by contexts sorted by their anchor; an anchor with more than ``split``
    distinct contexts leaves as it came, in h, at, ctx and who."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, wide, spans, rest = None, {}, False, [], []
        for batch in batches:
            who = batch.column("who")
            ends = np.cumsum(np.asarray(pc.list_value_length(who), np.int64)).tolist()
            flat, at = np.asarray(who.flatten(), np.int64).tolist(), 0
            for h, place, ctx, end in zip(batch.column("h").to_pylist(), batch.column("at").to_pylist(), batch.column("ctx").to_pylist(), ends):
                if h != now:
                    if held:
                        spans += _removed(held)
                    now, held, wide = h, {}, False
                own, at = flat[at:end], end
                if wide:
                    rest.append((h, place, ctx, own))
                    continue
                held.setdefault((ctx, place), []).extend(own)
                if len(held) > split:
                    rest += [(h, place, ctx, own) for (ctx, place), own in held.items()]
                    held, wide = {}, True
            if len(spans) + len(rest) > 20_000:
                yield from _spans_and_rest(spans, rest)
                spans, rest = [], []
        if held:
            spans += _removed(held)
        yield from _spans_and_rest(spans, rest)

    return run


def _removed(held: dict[tuple[bytes, int], list[int]]) -> list[tuple[int, int, int, int]]:
    """(doc_id, label, a, b) for the contexts of one anchor: what a document with a smaller doc_id has in a group, and whole contexts after the first."""
    out: list[tuple] = []
    keys, whos = list(held), list(held.values())
    least = [who[0] if len(who) == 3 else min(who[::3]) for who in whos]
    spans: list[list[tuple[int, int]]] = [[] for _ in keys]
    sides = [(ctx[:at][::-1], ctx[at:]) for ctx, at in keys]
    if len(keys) == 2:
        left, right = _prefix(sides[0][0], sides[1][0]), _prefix(sides[0][1], sides[1][1])
        if left + right >= LENGTH and least[0] != least[1]:
            m = int(least[1] > least[0])
            spans[m].append((keys[m][1] - left, keys[m][1] + right))
    elif len(keys) > 2:
        for left, right, members in maximal_groups(sides):
            lowest = min(least[m] for m in members)
            for m in members:
                if least[m] > lowest:
                    spans[m].append((keys[m][1] - left, keys[m][1] + right))
    for (ctx, _), who, low, own in zip(keys, whos, least, spans):
        own = merged(own) if len(own) > 1 else own
        for i in range(0, len(who), 3):
            doc, label, start = who[i : i + 3]
            out += [(doc, label, start, start + len(ctx))] if doc > low else [(doc, label, start + a, start + b) for a, b in own]
    return out


def _spans_and_rest(spans: list[tuple], rest: list[tuple]) -> Iterator[pa.RecordBatch]:
    names, types = ("doc_id", "label", "a", "b", "h", "at", "ctx", "who"), (*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.list_(pa.int64()))
    for rows, given in ((spans, range(4)), (rest, range(4, 8))):
        if rows:
            values = dict(zip(given, zip(*rows)))
            yield pa.RecordBatch.from_arrays([pa.array(values[i], t) if i in values else pa.nulls(len(rows), t) for i, t in enumerate(types)], list(names))


def repeated_spans(docs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, label, spans): bytes that lie in a string of 50 bytes of a document with a smaller doc_id, first copies of texts only.

    Anchors are judged in rounds by their hash, so the contexts at hand take a bounded share of the bytes of the texts.
    """
    marked, rounds, parts = _marked(docs, rows, texts)
    schema, spans = "doc_id bigint, label bigint, a bigint, b bigint, h bigint, at int, ctx binary, who array<bigint>", []
    for turn in range(rounds):
        found = _contexts_of(marked, turn).repartition("h").sortWithinPartitions("h")
        judged = settle(found.mapInArrow(_judged_anchors(SPLIT), schema), parts)
        spans.append(judged.filter(F.col("doc_id").isNotNull()).select("doc_id", "label", "a", "b"))
        wide = judged.filter(F.col("ctx").isNotNull()).select("h", "at", "ctx", "who")
        if not wide.isEmpty():
            spans.append(settle(_spans_by_strings(wide, parts), parts))
    if hasattr(marked, SETTLED):
        discard(marked)
    both = reduce(DataFrame.unionAll, spans)
    return both.groupBy("doc_id", "label").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _spans_by_strings(wide: DataFrame, parts: int) -> DataFrame:
    """(doc_id, label, a, b) of the repeated bytes in contexts of any number, string by string."""
    docs = F.transform(F.sequence(F.lit(0), (F.size("who") / 3).cast("int") - 1), lambda i: F.get("who", i * 3))
    rows = wide.select("h", F.xxhash64("ctx", "at").alias("cid"), "ctx", F.array_min(docs).alias("doc"))
    unique = settle(rows.groupBy("h", "cid").agg(F.min("doc").alias("doc"), F.first("ctx").alias("ctx")), parts)
    strings = settle(_strings(unique), parts)
    least = strings.groupBy("string").agg(F.min("doc").alias("least"))
    later = strings.join(least, "string").filter(F.col("doc") > F.col("least"))
    of_context = settle(later.select("h", "cid", F.col("shift").cast("bigint").alias("a"), (F.col("shift") + LENGTH).cast("bigint").alias("b")), parts)
    own = _occurrences(wide.withColumn("size", F.octet_length("ctx")), "h", "size")
    copies = own.join(unique.select("h", "cid", "doc"), ["h", "cid"]).filter(F.col("doc_id") > F.col("doc"))
    whole = copies.select("doc_id", "label", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    partly = own.join(of_context, ["h", "cid"]).select("doc_id", "label", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))
    return whole.unionAll(partly)


def _edited(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, label, n_removed, n_spans, kept): the first copies of texts that lose bytes, with the bytes left."""

    def edit(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, counts, kept = [], [], []
        for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, at, parts = text.encode(), 0, []
            clean = merged([(s["a"], s["b"]) for s in own])
            for start, stop in clean:
                parts.append(raw[at:start])
                at = stop
            kept.append(b"".join([*parts, raw[at:]]))
            removed.append(len(raw) - len(kept[-1]))
            counts.append(len(clean))
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "n_removed", "n_spans", "kept"])

    texts = _identified(docs).select("doc_id", "text", F.xxhash64("sha").alias("label"))
    joined = texts.join(spans, ["doc_id", "label"]).select("doc_id", "label", "text", "spans")
    return map_batches(joined, edit, "doc_id bigint, label bigint, n_removed bigint, n_spans bigint, kept binary", "text", 4 << 20)


def remove_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and kept with ``keep_bytes``: one row per row of docs.

    Texts count as UTF-8 bytes. Every byte in a string of 50 bytes that also starts in a document with a smaller doc_id
    is removed, as judged on the input; n_spans counts the maximal removed runs. A text equal to one of a smaller
    doc_id goes whole when it has 50 bytes. Null and empty texts have no bytes; a row without doc_id loses nothing and
    makes nobody lose anything. Rows of equal doc_id do not judge each other, so of equal texts those of the smallest doc_id
    stay. Texts of any length are read whole, 1 MB at a time unless one is longer. Other columns are not read, whatever
    their names. An empty table gives an empty one. kept is null where nothing was removed.
    """
    return _judged(docs, keep_bytes)


def _judged(docs: DataFrame, keep_bytes: bool) -> DataFrame:
    rows, texts, size = _rows(docs)
    spans = repeated_spans(docs, rows, texts)
    parts, first = parts_for(docs.sparkSession, size, PART_BYTES), texts.select("sha", "first")
    edits = _edited(docs, spans).groupBy("doc_id", "label").agg(
        F.first("n_removed").alias("n_removed"), F.first("n_spans").alias("n_spans"),
        F.first(F.sha2("kept", 256)).alias("left"), *([F.first("kept").alias("kept")] if keep_bytes else []),
    )
    edits = settle(edits, parts)
    joined = rows.join(first, "sha", "left").withColumn("label", F.xxhash64("sha")).join(edits, ["doc_id", "label"], "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    zero = F.lit(0).cast("bigint")
    out = [
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("bigint")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    ]
    if keep_bytes:
        out += ["label", F.when(copy, F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")]
    return joined.select(*out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; documents stay, also with nothing left.

    A character that a removal cuts goes with it. All other columns are as they were, whatever their names. An empty
    table gives an empty one.
    """
    lost = F.col("n_removed") > 0
    changed = settle_alone(lambda: _judged(docs, True).filter(lost).select(F.col("doc_id").alias("id"), "label", "kept").distinct())
    left = map_batches(changed, _as_text, "id bigint, label bigint, kept string")
    id_, label, kept, own = free_names(docs, "id_of_text", "label_of_text", "kept_text", "own_label")
    left = left.select(F.col("id").alias(id_), F.col("label").alias(label), F.col("kept").alias(kept))
    keyed = docs.withColumn(own, F.xxhash64(F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256)))
    joined = keyed.join(left, (F.col("doc_id").cast("bigint") == F.col(id_)) & (F.col(own) == F.col(label)), "left")
    return joined.withColumn("text", F.coalesce(kept, "text")).select(*[column(c) for c in docs.columns])


def _as_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(texts, pa.string())], ["id", "label", "kept"])
