"""Token counts by byte-pair merging with a heap and a linked list, and the split of texts that the ID writer shares.

A text falls into chunks at single spaces that stand before something that isn't white space; there a pre-token always ends, so
chunks count on their own. Arrow finds the distinct chunks of a batch, and their counts are kept in a bounded table. A chunk that is new
is cut into pre-tokens, by the library's splitter where it isn't plainly letters and signs, and in each
of those the adjacent pair of lowest rank is merged again and again: a heap has the pairs, a doubly linked list the symbols. The
count is the number of bytes minus the number of merges; no identifier is made.

Defined results: a null text counts as empty, with no token; a special token's string inside a text is one token; repeated rows
are counted each; an empty table gives an empty table. A long text without spaces costs n log n for its n bytes.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship
from .chunks import HEAD, ODD, SIMPLE, spell

#: Entries of a table of chunks, and letters of the longest chunk in it; a full table is emptied.
KEPT, LONGEST = 300_000, 64
#: A space that is not the start of a chunk, or a control character that libraries class differently.
_IRREGULAR = re.compile(r" (?=\s|\Z)|[\x1c-\x1f]")


class HeapMerger:
    """Ranks of pairs; count(symbols) merges them."""

    def __init__(self, merges: list):
        self.ranks = {}
        for rank, m in enumerate(merges):
            pair = tuple(m) if isinstance(m, list) else tuple(m.split(" "))
            self.ranks.setdefault(pair, rank)

    def count(self, piece: str) -> int:
        symbols, ranks, n = list(piece), self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(p)) is not None]
        heapify(heap)
        merged = 0
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair[0] + pair[1], ""
            after[i] = k = after[j]
            merged += 1
            if k < n:
                before[k] = i
                if (r := ranks.get(p := (symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i, p))
            if (h := before[i]) >= 0 and (r := ranks.get(p := (symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h, p))
        return n - merged


class _Kept(dict):
    """Values by chunk; make gives a missing one."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts the tokens of texts as the vocabulary file's library does."""

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is known")
        self.pre = ByteLevel(add_prefix_space=False, use_regex=pre.get("use_regex", True))
        self.merger = HeapMerger(model["merges"])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.piece = _Kept(self.merger.count)
        self.odd = "|".join([ODD, *map(re.escape, special)])
        self.inner, self.first = _Kept(lambda chunk: self.chunk(" " + chunk, SIMPLE)), _Kept(lambda chunk: self.chunk(chunk, HEAD))

    def pieces(self, text: str) -> int:
        return sum(self.piece[p] for p, _ in self.pre.pre_tokenize_str(text)) if text else 0

    def chunk(self, text: str, pattern: re.Pattern) -> int:
        m = pattern.fullmatch(text)
        if m is None:
            return self.pieces(text)
        stem, tail, stem2, tail2 = m.groups()
        out = self.merger.count(spell(stem)) + (self.piece[spell(tail)] if tail else 0)
        return out + 1 + self.merger.count(spell(stem2)) + (self.piece[spell(tail2)] if tail2 else 0) if stem2 else out

    def batch(self, texts: pa.Array) -> np.ndarray:
        """The counts of many texts; a null one is empty."""
        texts = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if len(split):
            chunks, per = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.dictionary_encode(chunks)
            names = coded.dictionary.to_pylist()
            n = np.fromiter(map(self.inner.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
            begin = np.cumsum(per) - per
            heads = chunks.take(pa.array(begin)).to_pylist()
            n[begin] = [self.first[h] if h else 0 for h in heads]
            out[~odd] = np.add.reduceat(n, begin)
        out[odd] = [self(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        return out

    def segment(self, text: str) -> int:
        if _IRREGULAR.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        return (self.first[head] if head else 0) + sum(map(self.inner.__getitem__, rest))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        return sum(map(self.segment, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit."""
    ship(docs.sparkSession)

    def run(batches):
        count = counter(vocabulary)
        for b in batches:
            n = count.batch(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"))
    return cols.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
