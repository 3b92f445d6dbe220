"""Source divergence audit: how the words of each source of a language differ from those of its other sources, and which
words stand out in it.

The words that stand out are found by dominance. With a higher count in the group, a lower count in the language and an
earlier place in byte order a term ranks before another whatever the totals are, so a term that k others dominate in all
three is not among the first k. Tasks keep their k-skybands, skybands are merged, and what is left is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewise.llm.common import slices, text_bytes
from citewise.llm.spans import LOWER, byte_class, gather, larger_batches, segments, strings, word_spans
from citewise.plans.materialize import settle

OUTSIDE = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # bytes that no term has
AT_ONCE = 2 << 20  # bytes of text that a task holds as arrays
ROWS_AT_ONCE = 50_000
TERMS_AT_ONCE = 50_000  # kept terms of a language in one task
CELLS_AT_ONCE = 1 << 21  # counts of terms x sources held as one array
BLOCK = 1024
GRID = 64
FAN = 16  # skybands merged in one task
SCALE = 1_000_000_000


def _heads(keys: np.ndarray) -> np.ndarray:
    """First place of every run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _counted(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, then for each group and term: the group, place of the term, occurrences, texts that hold it); group is each text's."""
    words, rows = [], []
    for part, begun, row in segments(raw, starts, ends, OUTSIDE, AT_ONCE):
        part = LOWER[part]
        first, last = word_spans(~OUTSIDE[part], begun)
        words.append(strings(*gather(part, first, last)))
        rows.append(row[np.searchsorted(begun, first, side="right") - 1])
    coded = pa.chunked_array(words, pa.large_string()).combine_chunks().dictionary_encode()
    size = max(len(coded.dictionary), 1)
    keys = np.concatenate([*rows, np.zeros(0, np.int64)]) * size + np.asarray(coded.indices, np.int64)
    keys.sort()
    heads = _heads(keys)
    occurs, row, code = np.diff(np.append(heads, len(keys))), keys[heads] // size, keys[heads] % size
    keys = group[row] * size + code
    order = np.argsort(keys)
    heads = _heads(keys[order])
    own = keys[order][heads]
    summed = np.add.reduceat(occurs[order], heads) if len(heads) else occurs
    return coded.dictionary, own // size, own % size, summed, np.diff(np.append(heads, len(keys)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group, and the rows of it that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger_batches(batches, AT_ONCE):
            for part in slices(batch, "text", AT_ONCE):
                lang, source = (part.column(name).dictionary_encode() for name in ("lang", "source"))
                sources = len(source.dictionary)
                group = np.asarray(lang.indices, np.int64) * sources + np.asarray(source.indices, np.int64)
                terms, own, code, n, docs = _counted(*text_bytes(part.column("text")), group)
                for at in range(0, len(own), ROWS_AT_ONCE):
                    here = slice(at, at + ROWS_AT_ONCE)
                    yield pa.record_batch({
                        "lang": lang.dictionary.take(pa.array(own[here] // sources)), "source": source.dictionary.take(pa.array(own[here] % sources)),
                        "term": terms.take(pa.array(code[here])).cast(pa.string()), "n": n[here], "docs": docs[here],
                    })

    found = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) by long division in three steps of 1000, exact while totals are below 9 * 10^15."""
    whole, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        whole = whole * 1000 + more
    return whole + 1


def pair_sums(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """For every two columns the sum over the terms of floor((p - q)^2 / q)."""
    p = smoothed(counts, totals[None, :])
    sums = np.zeros((len(totals), len(totals)), np.int64)
    for g in range(len(totals)):
        apart = p[:, g : g + 1] - p
        sums[g] = (apart * apart // p).sum(axis=0)
    return sums


def skyband(up: np.ndarray, down: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Points that fewer than k others dominate: at least as high in up, at most as high in down, earlier in place.

    Points are taken in an order in which dominators come first. It is enough to compare with the points kept so far and
    those of the same block: the first k dominators of a point are all kept ones. Per grid value of down the k-th
    earliest kept place rules most points out before they are compared one by one.
    """
    order = np.lexsort((place, down, -up))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), BLOCK):
        block = order[at : at + BLOCK]
        if len(kept) >= k:
            grid = np.unique(np.quantile(down[kept], np.linspace(0, 1, GRID), method="lower"))
            latest = np.full(len(grid) + 1, np.iinfo(np.int64).max)
            for i, value in enumerate(grid):
                under = place[kept][down[kept] <= value]
                if len(under) >= k:
                    latest[i + 1] = np.partition(under, k - 1)[k - 1]
            block = block[place[block] < latest[np.searchsorted(grid, down[block], side="right")]]
        if not len(block):
            continue
        before = (down[kept][None, :] <= down[block][:, None]) & (place[kept][None, :] < place[block][:, None])
        beside = (down[block][None, :] <= down[block][:, None]) & (place[block][None, :] < place[block][:, None])
        dominators = before.sum(axis=1) + np.tril(beside, -1).sum(axis=1)
        kept = np.concatenate([kept, block[dominators < k]])
    return np.sort(kept)


def _compared(k: int):
    """One task's kept terms with all sources of their language: partial pair sums and a skyband for every source."""

    def compare(terms: pa.Table, groups: pa.Table) -> pa.Table:
        empty = {"part": [], "source": [], "item": [], "n": np.zeros(0, np.int64), "total": np.zeros(0, np.int64)}
        out = [pa.table({name: pa.array(v, pa.string() if name in ("part", "source", "item") else pa.int64()) for name, v in empty.items()})]
        if terms.num_rows and groups.num_rows:
            terms, groups = terms.sort_by("term"), groups.sort_by("source")
            sources = groups.column("source").combine_chunks()
            totals = np.asarray(groups.column("n"), np.int64) + np.asarray(groups.column("kept"), np.int64)
            term, total = terms.column("term").combine_chunks(), np.asarray(terms.column("total"), np.int64)
            parts = terms.column("parts").combine_chunks()
            row, values = np.asarray(pc.list_parent_indices(parts), np.int64), parts.flatten()
            column = np.asarray(pc.index_in(values.field("source"), value_set=sources), np.int64)
            n = np.asarray(values.field("n"), np.int64)
            sums, step = np.zeros((len(sources), len(sources)), np.int64), max(1, CELLS_AT_ONCE // len(sources))
            for at in range(0, len(term), step):
                low, high = np.searchsorted(row, [at, at + step])
                counts = np.zeros((min(step, len(term) - at), len(sources)), np.int64)
                counts[row[low:high] - at, column[low:high]] = n[low:high]
                sums += pair_sums(counts, totals)
            one, other = np.divmod(np.arange(sums.size), len(sources))
            apart = np.flatnonzero(one != other)
            out.append(_part("pair", sources.take(pa.array(one[apart])), sources.take(pa.array(other[apart])), sums.ravel()[apart], np.zeros(len(apart), np.int64)))
            order = np.argsort(column, kind="stable")
            heads = _heads(column[order])
            for g, own in zip(column[order][heads].tolist(), np.split(order, heads[1:])):
                best = own[skyband(n[own], total[row[own]], row[own], k)]
                out.append(_part("term", pa.repeat(sources[g], len(best)), term.take(pa.array(row[best])), n[best], total[row[best]]))
        return pa.concat_tables(out)

    def keyed(key: tuple, terms: pa.Table, groups: pa.Table) -> pa.Table:
        found = compare(terms, groups)
        for at, (name, value) in enumerate(zip(("lang", "deal"), key)):
            found = found.add_column(at, name, pa.repeat(value, found.num_rows))
        return found

    return keyed


def _part(part: str, source: pa.Array, item: pa.Array, n: np.ndarray, total: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.repeat(pa.scalar(part), len(n)), "source": source, "item": item, "n": n, "total": total})


def _merged(bands: DataFrame, deals: int, k: int) -> DataFrame:
    """Skybands of the same group merged, so many at a time, until every group has one."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        up, down = np.asarray(table.column("n"), np.int64), np.asarray(table.column("total"), np.int64)
        return table.take(pa.array(skyband(up, down, np.arange(table.num_rows), k)))

    while deals > 1:
        bands = bands.withColumn("deal", F.expr(f"deal div {FAN}"))
        bands = settle(bands.groupBy("lang", "source", "deal").applyInArrow(merge, bands.schema))
        deals = -(-deals // FAN)
    return bands.select("lang", "source", "item", "n", "total")


def _p(count: str, total: str) -> str:
    return f"(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(20,0)))"


def source_divergence(docs: DataFrame, least_docs: int = 3, first: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language its other sources by divergence (part
    ``pair``, all of them) and the first terms in which it exceeds the language (part ``term``).

    docs(text, lang, source): null counts as ''. Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased;
    a language keeps those of at least least_docs of its rows, every row being a document, repeated ones too. A group or
    language with N occurrences of V kept terms gives a term p = 1 + floor(10^9 * (count + 1) / (N + V)). Equal values
    stand by item in byte order. Groups without text or terms take part with count 0; without kept terms values are 0 and
    there are no terms. Texts of any length are read whole, 2 MB at a time. Work is the number of kept terms times the
    square of the number of sources of a language, as its result has that many pairs. Other columns are not read,
    whatever their names. An empty table gives an empty result.
    """
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    texts = docs.select(*told)
    counts = term_counts(texts)
    whole = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("parts")
    )
    kept = settle(whole.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "parts"))

    sums = kept.select("lang", F.explode("parts").alias("part")).groupBy("lang", F.col("part.source").alias("source")).agg(F.sum("part.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    occurring = texts.select("lang", "source").distinct()
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "kept", "lang_n")]
    groups = settle(occurring.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *zero))

    deals = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS_AT_ONCE)).cast("int")
    by_lang = settle(groups.groupBy("lang").agg(F.max("kept").alias("kept")).withColumn("deals", deals))
    dealt = kept.join(by_lang.select("lang", "deals"), "lang").withColumn("deal", F.pmod(F.xxhash64("term"), F.col("deals")).cast("int")).drop("deals")
    beside = groups.join(by_lang.select("lang", "deals"), "lang").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
    schema = "lang string, deal int, part string, source string, item string, n bigint, total bigint"
    found = settle(dealt.groupBy("lang", "deal").cogroup(beside.groupBy("lang", "deal")).applyInArrow(_compared(first), schema))

    none = groups.filter("kept = 0").select("lang", "source")
    bare = none.join(none.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("n").alias("value"))
    pairs = pairs.unionByName(bare).withColumn("part", F.lit("pair"))

    most = by_lang.agg(F.coalesce(F.max("deals"), F.lit(1))).first()[0]
    bands = _merged(found.filter("part = 'term'").drop("part"), most, first)
    terms = bands.join(groups.withColumnRenamed("n", "group_n"), ["lang", "source"])
    terms = terms.withColumn("p", F.expr(_p("n", "group_n + kept"))).withColumn("q", F.expr(_p("total", "lang_n + kept"))).filter("p > q")
    terms = terms.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"), F.lit("term").alias("part"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [part.withColumn("rank", F.row_number().over(order)) for part in (pairs, terms)]
    both = ranked[0].unionByName(ranked[1].filter(F.col("rank") <= first))
    return both.select("lang", "source", "part", "item", "value", "rank")
