"""Token counts: whole documents are encoded once and their token spans attributed to sections."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewise.llm.common import map_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Split pattern that belongs to the vocabulary file; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first_byte", "most_bytes", "shared")
SECTION = re.compile(rb"[^\n]*(?:\n+|$)")
# Fixed value: the characters that \s of the pattern means. Long runs are cut out before the pattern sees them, which would
# go one level deeper for each of their characters.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


@lru_cache(maxsize=1)
def encoder(path: str):
    """(encoder, bytes of every token) of a rank file, once per worker."""
    ranks = ranks_of(path)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return _encoding(ranks, PATTERN), lengths


@lru_cache(maxsize=1)
def piece_encoder(path: str):
    """The encoder of texts that are one piece of the pattern."""
    return _encoding(ranks_of(path), r"[\s\S]+")


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def encode_text(text: str, coder, piece_coder) -> list[int]:
    """Tokens of a text. A run of white space is one piece up to its last character, which the pattern leaves to what
    follows, so the text may be cut around long runs without a change of tokens."""
    tokens, at = [], 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        tokens += coder.encode_ordinary(text[at : run.start()]) + piece_coder.encode_ordinary(text[run.start() : stop])
        at = stop
    return tokens + coder.encode_ordinary(text[at:])


def line_sections(raw: bytes) -> np.ndarray:
    """Ends of the sections of a text: a line with the line breaks behind it."""
    ends = [m.end() for m in SECTION.finditer(raw) if m.end() > m.start()]
    return np.asarray(ends, np.int64)


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, crossing tokens, share) per section from the ends of adjoining tokens and adjoining sections.

    The join of the two interval lists is a binary search, as both are sorted. A token that lies in several sections
    is counted where its first byte lies, where most of its bytes lie (the earlier section when equal), or, as a
    share, in all of them by bytes; it is a crossing token of the section it is counted in.
    """
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(sections, starts, side="right")
    last = np.searchsorted(sections, ends - 1, side="right")
    n, crossing = len(sections), last > first
    home = first.copy()
    share = np.bincount(first[~crossing], minlength=n).astype(np.float64)
    for t in np.flatnonzero(crossing):
        cut = np.concatenate([[starts[t]], sections[first[t] : last[t]], [ends[t]]])
        held = np.diff(cut)
        share[first[t] : last[t] + 1] += held / held.sum()
        if rule == "most_bytes":
            home[t] = first[t] + int(np.argmax(held))
    tokens = np.bincount(home, minlength=n)
    crossed = np.bincount(home[crossing], minlength=n)
    return tokens, crossed, share if rule == "shared" else tokens.astype(np.float64)


def section_tokens(docs: DataFrame, rule: str = "first_byte", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, stop, n_tokens, n_crossing, share): one row per section of every document.

    Sections are lines with their line breaks, in bytes [start, stop); they cover the text. Token spans follow from
    the byte lengths of the tokens, since byte-level tokens spell the text exactly. ``rule`` says where a token across
    a border counts (see attribute); under "shared" n_tokens counts first bytes and share adds up to the token
    count. A null or empty text has no sections and no rows. Repeated rows give repeated rows. Texts of any length and
    of any run of white space are encoded whole, a bounded number of bytes at a time unless one text is longer. Equal
    halves of a token under "most_bytes" count in the earlier section. Other columns are not read, whatever their
    names. An empty table gives an empty one.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        (coder, lengths), piece_coder = encoder(vocabulary), piece_encoder(vocabulary)
        out: list[list] = [[] for _ in range(7)]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            stops = line_sections(text.encode())
            ends = np.cumsum(lengths[np.asarray(encode_text(text, coder, piece_coder), np.int64)])
            tokens, crossed, share = attribute(ends, stops, rule)
            starts = np.concatenate([[0], stops[:-1]])
            out[0].append(pa.array([doc_id] * len(stops), pa.int64()))
            for column, values in zip(out[1:], (np.arange(len(stops)), starts, stops, tokens, crossed, share)):
                column.append(pa.array(values, pa.float64() if values is share else pa.int64()))
        types = [pa.int64()] * 6 + [pa.float64()]
        names = ["doc_id", "section", "start", "stop", "n_tokens", "n_crossing", "share"]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) if c else pa.array([], t) for c, t in zip(out, types)], names)

    schema = "doc_id bigint, section bigint, start bigint, stop bigint, n_tokens bigint, n_crossing bigint, share double"
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), count, schema, "text")
