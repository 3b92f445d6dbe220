"""Language identification by cross-parsing: suffix automata of labelled text, fewest normalised phrases win."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewise.llm.common import add_columns, by_parts, unit_hash

UNKNOWN = "und"
SAMPLE_TEXTS = 48  # expected texts that a language's sample takes a piece from
PIECE = 1024  # characters of a piece
LANE = 512  # characters that are parsed as one run
SLICE_BYTES = 1 << 20
LETTER = r"\p{L}"
OTHER, GAP = 0, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def draw_sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, piece: int = PIECE) -> dict[str, str]:
    """Text per language: one piece from a hash-chosen place of about ``texts`` hash-chosen distinct texts, so the size is bounded.

    Copies of a text count once. A text without a letter is not usable; every language with a usable text gives a piece.
    """
    usable = labelled.select("text", "lang").filter(F.col("text").rlike(LETTER) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    keyed = usable.withColumns({"h": F.xxhash64("text"), "u": unit_hash("text", seed=5)})
    distinct = keyed.groupBy("lang", "h").agg(F.min("u").alias("u"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in distinct.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least")).collect()}
    if not counts:
        return {}
    # u is below the bound or equal to it, so that the text of the smallest u is always drawn
    bound = F.create_map(*[F.lit(v) for lang, (n, least) in counts.items() for v in (lang, max(texts / n, least))])
    room = F.greatest(F.length("text") - piece, F.lit(0))
    cut = F.substring("text", (F.pmod(F.xxhash64(F.lit(7), "text"), room + 1) + 1).cast("int"), F.lit(piece))
    lettered = F.when(cut.rlike(LETTER), cut).otherwise(F.regexp_extract("text", f"(?s){LETTER}.{{0,{piece - 1}}}", 0))
    drawn = keyed.filter(F.col("u") <= F.element_at(bound, F.col("lang"))).select("lang", lettered.alias("piece"), "h")
    # many equal texts fall to one hash; equal pieces count once
    pieces: dict[str, set] = {}
    for r in drawn.distinct().orderBy("lang", "h").limit(4 * texts * len(counts)).collect():
        pieces.setdefault(r["lang"], set()).add((r["h"], r["piece"]))
    return {lang: " ".join(p for _, p in sorted(found)[: 2 * texts]) for lang, found in sorted(pieces.items())}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring of the sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[state] = twin
        last = state
    return moves


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Parser:
    """Counts of phrases for every language, many runs of characters at a time."""

    def __init__(self, sample: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in sample]
        folded = [code_points(text.lower()) for _, text in sample]
        seen = np.unique(np.concatenate([np.unique(f) for f in folded])) if folded else np.zeros(0, np.uint32)
        alphabet = seen[letters()[seen]]
        self.classes = np.full(0x110000, GAP, np.uint16)
        self.classes[letters()] = OTHER
        self.classes[alphabet] = np.arange(len(alphabet)) + 2
        self.width = len(alphabet) + 3
        self.pad = self.width - 1
        self.weight, self.tables = [], []
        for points in folded:
            codes = self.squeeze(self.classes[points])
            moves = suffix_automaton(codes.tolist())
            self.tables.append(self.table(moves))
            self.weight.append(math.log2(len(codes) + 2))

    @staticmethod
    def squeeze(codes: np.ndarray) -> np.ndarray:
        """Runs of characters that are no letters count as one."""
        if len(codes) < 2:
            return codes
        return codes[np.concatenate([[True], (codes[1:] != GAP) | (codes[:-1] != GAP)])]

    def table(self, moves: list[dict[int, int]]) -> np.ndarray:
        """2 * (next state * width) + 1 where a phrase has to end before the character."""
        start = np.zeros(self.width, np.int64)
        for c, to in moves[0].items():
            start[c] = to
        start[OTHER] = 0
        full = np.tile(start * self.width * 2 + 1, (len(moves), 1))
        for state, out in enumerate(moves):
            for c, to in out.items():
                if c != OTHER:
                    full[state, c] = to * self.width * 2
        full[:, self.pad] = np.arange(len(moves)) * self.width * 2
        return full.astype(np.int32 if full.max() < 2**31 else np.int64).ravel()

    def phrases(self, runs: np.ndarray) -> np.ndarray:
        """(languages, runs): phrases of each column of codes, the longest known string taken at each point."""
        found = np.zeros((len(self.langs), runs.shape[1]), np.int64)
        for i, table in enumerate(self.tables):
            state = np.zeros(runs.shape[1], table.dtype)
            ended = np.ones(runs.shape[1], table.dtype)
            for codes in runs:
                value = table.take(state + codes)
                ended += value & 1
                state = value >> 1
            found[i] = ended
        return found


@lru_cache(maxsize=1)
def parser(sample: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(sample)


def predict(texts: list[str | None], model: Parser) -> tuple[list[str], list[float]]:
    codes, owner = [], []
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for i, text in enumerate(texts):
        if not text or not model.langs:
            continue
        points = code_points(text.lower())
        if not letters()[points].any():
            continue
        own = model.squeeze(model.classes[points])
        codes.append(np.pad(own, (0, -len(own) % LANE), constant_values=model.pad))
        owner.append((i, len(own)))
    if not codes:
        return langs, scores
    runs = np.ascontiguousarray(np.concatenate(codes).reshape(-1, LANE).T)
    starts = np.cumsum([0] + [len(c) // LANE for c in codes[:-1]])
    found = np.add.reduceat(model.phrases(runs.astype(np.int32)), starts, axis=1)
    rates = found * np.asarray(model.weight)[:, None] / np.asarray([n for _, n in owner])
    for (i, _), rate in zip(owner, rates.T):
        order = np.argsort(rate, kind="stable")
        langs[i] = model.langs[order[0]]
        scores[i] = float(1 - rate[order[0]] / rate[order[1]]) if len(order) > 1 else 1.0
    return langs, scores


def identify_language(docs: DataFrame, labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """docs with lang_pred and score.

    ``labelled`` (text, lang) gives a bounded sample per language (about ``texts`` pieces of 1,024 characters); a
    suffix automaton of each sample parses every whole text into longest known strings. Phrases times the logarithm of
    the sample's size over the length of the text is the cross-parsing entropy; the lowest wins, the smaller language
    name among equals. score is 1 - lowest / second lowest (1 with a single language). Letters are compared in lower case,
    everything else counts as a gap. A text that is null or has no letter, or any text when nothing is labelled, is
    "und" with score 0. Long texts are parsed in runs of 512 characters. Repeated rows get equal answers; input columns named lang_pred or score are
    replaced, others stay whatever their names. An empty table gives an empty one.
    """
    sample = tuple(sorted(draw_sample(labelled, texts).items()))
    kept = docs.drop("lang_pred", "score")
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def label(part: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = predict(part.column("text").to_pylist(), parser(sample))
        names = [*part.schema.names, "lang_pred", "score"]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    return add_columns(kept, by_parts(label, "text", SLICE_BYTES), added)
