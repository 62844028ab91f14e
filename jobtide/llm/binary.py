"""Token IDs in compressed files, one wavelet matrix a shard.

A shard's file holds a run of documents in ascending doc_id order. Plane by plane from the top bit of the identifiers, the matrix
keeps the bits of all tokens, and each plane puts the tokens with a 0 before those with a 1, in the same order otherwise. With
counts of ones at every 4,096th bit, a token, the occurrences of an identifier up to a place and the place of its k-th occurrence
each take one step a plane. Sections are compressed on their own: header, document numbers, lengths, planes, counts.

Spark deals the documents out by ranges of doc_id, each task writes shards of SHARD_TEXT text bytes at most (a longer document is a shard
by itself), and Spark's writer commits the files, one shard each, to the shared folder. So a lost executor costs its tasks only.

Defined results: a null text counts as empty: its one token is the end; a null doc_id comes first; repeated rows are documents
of their own; an empty table gives no file and an empty table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MAX_SMALL, broadcast_if_small, offsets, shared_dir, ship
from .chunks import ODD, PARTS, spell
from .tokens import LONGEST

END, SHARD_TEXT, SAMPLE, MAGIC = 2, 16 << 20, 4096, b"JTWM\x01"
#: Letters of the texts that are encoded together, and pre-tokens whose identifiers are kept; a full table is emptied. Bits parted at once.
TOGETHER, KEPT, PARTED = 8 << 20, 600_000, 1 << 16
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _parted(now: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, int]:
    """now with those that aren't one first, in the same order otherwise, and how many they are: by places, a stretch at a time, which
    takes half the time of masks."""
    out, zero, z = np.empty_like(now), ~one, len(now) - int(np.count_nonzero(one))
    low, high = 0, z
    for i in range(0, len(now), PARTED):
        some = now[i : i + PARTED]
        a, b = np.flatnonzero(zero[i : i + PARTED]), np.flatnonzero(one[i : i + PARTED])
        np.take(some, a, out=out[low : low + len(a)], mode="clip")
        np.take(some, b, out=out[high : high + len(b)], mode="clip")
        low, high = low + len(a), high + len(b)
    return out, z


class WaveletMatrix:
    """n identifiers of width bits; planes are bytes, low bit first."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[np.ndarray], counts: list[np.ndarray]):
        self.n, self.width, self.zeros, self.planes, self.counts = n, width, zeros, planes, counts

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        now, zeros, planes, counts = ids, [], [], []
        for bit in range(width - 1, -1, -1):
            one = (now & now.dtype.type(1 << bit)) != 0
            packed = np.packbits(one, bitorder="little")
            now, z = _parted(now, one)
            zeros.append(z)
            planes.append(packed)
            blocks = np.add.reduceat(_ONES[packed], np.arange(0, len(packed), SAMPLE // 8), dtype=np.uint32) if len(packed) else np.zeros(0, np.uint32)
            counts.append(np.concatenate(([0], np.cumsum(blocks[:-1], dtype=np.uint32))).astype(np.uint32) if len(blocks) else blocks)
        return cls(len(ids), width, zeros, planes, counts)

    def decode(self) -> np.ndarray:
        """All identifiers: from the last plane up, each plane puts its tokens back where they were."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, back = self.zeros[level], np.empty(self.n, kind)
            back[~one] = now[:z]
            back[one] = now[z:] | kind(1 << (self.width - 1 - level))
            now = back
        return now

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0 or not self.n:
            return 0
        block = min(i // SAMPLE, len(self.counts[level]) - 1)
        start, byte = block * (SAMPLE // 8), i // 8
        rest = int(self.planes[level][byte]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(self.counts[level][block]) + int(_ONES[self.planes[level][start:byte]].sum()) + rest.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out, i = out << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        """Where the token's occurrences among places i to j - 1 stand after the last plane."""
        for level in range(self.width):
            a, b = self._ones(level, i), self._ones(level, j)
            if token >> (self.width - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token among the first i."""
        if token >> self.width:
            return 0
        a, b = self._range(token, 0, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if token >> self.width or not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, 0)[0] + k
        for level in range(self.width - 1, -1, -1):
            one = token >> (self.width - 1 - level) & 1
            need = at - self.zeros[level] if one else at  # the bit before which so many of its kind stand
            low, high = 0, self.n - 1
            while low < high:
                mid = (low + high) // 2
                upto = self._ones(level, mid + 1)
                if (upto if one else mid + 1 - upto) > need:
                    high = mid
                else:
                    low = mid + 1
            at = low
        return at


class Shard:
    """Documents of one file: doc_ids (None where null), lengths, and the matrix of all their tokens."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix

    def to_bytes(self) -> bytes:
        c, m = zstandard.ZstdCompressor(level=1), self.matrix
        known = np.array([x is not None for x in self.doc_ids], bool)
        numbers = np.array([x or 0 for x in self.doc_ids], "<i8")
        sections = [np.packbits(known).tobytes(), numbers.tobytes(), self.lengths.astype("<u4").tobytes()]
        for plane, count in zip(m.planes, m.counts, strict=True):
            sections += [plane.tobytes(), count.astype("<u4").tobytes()]
        sections = [c.compress(s) for s in sections]
        head = json.dumps({"n": m.n, "width": m.width, "zeros": m.zeros, "docs": len(self.doc_ids), "sizes": [len(s) for s in sections]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        at = len(MAGIC) + 4
        size = struct.unpack_from("<I", raw, len(MAGIC))[0]
        head, at = json.loads(raw[at : at + size]), at + size
        d, parts = zstandard.ZstdDecompressor(), []
        for n in head["sizes"]:
            parts.append(d.decompress(raw[at : at + n]))
            at += n
        known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=head["docs"]).astype(bool)
        ids = [x if k else None for x, k in zip(np.frombuffer(parts[1], "<i8").tolist(), known.tolist(), strict=True)]
        planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
        counts = [np.frombuffer(p, "<u4") for p in parts[4::2]]
        return cls(ids, np.frombuffer(parts[2], "<u4"), WaveletMatrix(head["n"], head["width"], head["zeros"], planes, counts))


class Encoder:
    """Identifiers of texts by the vocabulary's library.

    A text is cut into chunks at single spaces, where a pre-token always ends. Arrow finds the distinct chunks of a group of texts and cuts
    those of letters and signs into their pre-tokens; a bounded table has the identifiers of pre-tokens that came before, the library's
    model encodes the new ones, and texts are put together by index. Other chunks go through the whole library. So do texts with
    other spaces than single ones, or with a special token's string."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.odd = "|".join([ODD, *map(re.escape, self.special)])
        self._empty()

    def _empty(self) -> None:
        """The table: a number for each pre-token, and by number where its identifiers begin in flat and how many they are. Number 0 has none."""
        self.number: dict[str, int] = {"": 0}
        self.first, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind), 0

    def _append(self, start: int, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total, end = int(size.sum()), start + len(lists)
        while end > len(self.size):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.size[start:end] = size
        self.first[start:end] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), self.kind, total)
        self.used += total

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of pre-tokens; new ones are put in the table."""
        coded = pc.dictionary_encode(pieces)
        names = coded.dictionary.to_pylist()
        out = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        if len(new):
            names, start, tokenize = [names[i] for i in new.tolist()], len(self.number), self.model.tokenize
            out[new] = np.arange(start, start + len(names))
            self._append(start, [[t.id for t in tokenize(spell(x))] for x in names])
            self.number.update(zip(names, range(start, start + len(names)), strict=True))
        return out[np.asarray(coded.indices)]

    def _chunks(self, chunks: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """The identifiers of chunks that stand after before (a space or nothing), one after another, and how many each has."""
        parts = pc.extract_regex(chunks, PARTS)
        plain = pc.and_(parts.is_valid(), pc.less_equal(pc.utf8_length(chunks), LONGEST))  # the table has no longer ones
        odd = pc.invert(plain)
        parts = parts.filter(plain)
        a, b, c, d = (parts.field(i) for i in range(4))
        more = pc.not_equal(c, "")
        rows, two = len(parts), np.flatnonzero(more.to_numpy(zero_copy_only=False))
        numbers = self._pieces(pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(before, a.type), a, pa.scalar("", a.type)), b, pa.array(["\n"], a.type), c.filter(more), d.filter(more)]))
        line = np.zeros((rows, 5), np.int64)
        line[:, 0], line[:, 1] = numbers[:rows], numbers[rows : 2 * rows]
        line[two, 2], line[two, 3], line[two, 4] = numbers[2 * rows], numbers[2 * rows + 1 : 2 * rows + 1 + len(two)], numbers[2 * rows + 1 + len(two) :]
        ids, upto = _together(self.first, self.size, self.flat, line.ravel())
        others = [e.ids for e in self.library.encode_batch_fast([before + x for x in chunks.filter(odd).to_pylist()], add_special_tokens=False)]
        n = np.concatenate((np.diff(upto[4::5], prepend=0), np.fromiter(map(len, others), np.int64, len(others))))
        ids = np.concatenate((ids, np.fromiter(chain.from_iterable(others), self.kind)))
        # plain ones first, then the others: back into the order of chunks
        place, plain = np.empty(len(chunks), np.int64), plain.to_numpy(zero_copy_only=False)
        place[plain], place[~plain] = np.arange(rows), np.arange(rows, len(chunks))
        return _together(np.cumsum(n) - n, n, ids, place)[0], n[place]

    def encode(self, texts: pa.Array, end: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers one after another, with end after each text, and how many each text has. A null text is empty."""
        if len(self.number) > KEPT:
            self._empty()
        texts, D = pc.fill_null(pa.concat_arrays([texts]).cast(pa.large_string()), ""), len(texts)
        is_whole = np.ones(D, bool)
        if self.chunked:
            is_whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~is_whole)), " ")
        chunks, per = split.flatten(), np.zeros(D, np.int64)
        per[~is_whole] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = pc.dictionary_encode(chunks)
        # what has no space before: the first chunk of a text, or all of a text that isn't plain; then the ends
        begins = np.cumsum(per) - per
        heads = pc.dictionary_encode(chunks.take(pa.array(begins[per > 0])))
        others = [e.ids for e in self.library.encode_batch_fast(texts.filter(pa.array(is_whole)).to_pylist(), add_special_tokens=False)]
        (ids1, n1), (ids2, n2), rest = self._chunks(coded.dictionary, " "), self._chunks(heads.dictionary, ""), [*others, list(end)]
        size = np.concatenate((n1, n2, np.fromiter(map(len, rest), np.int64, len(rest))))
        flat = np.concatenate((ids1, ids2, np.fromiter(chain.from_iterable(rest), self.kind)))
        base = len(n1) + len(n2)
        words = np.array(coded.indices, np.int64)
        words[begins[per > 0]] = len(n1) + np.asarray(heads.indices)
        # one more entry a text for its end, and one for all of a text that isn't plain
        count = per + is_whole + 1
        last = np.cumsum(count) - 1
        line = np.empty(int(count.sum()), np.int64)
        mark = np.ones(len(line), bool)
        mark[last] = False
        line[last] = base + len(others)
        mark[last[is_whole] - 1] = False
        line[last[is_whole] - 1] = base + np.arange(len(others))
        line[mark] = words
        ids, upto = _together(np.cumsum(size) - size, size, flat, line)
        return ids, np.diff(upto[last], prepend=0)


def _together(first: np.ndarray, size: np.ndarray, flat: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of line in turn, size from first on of flat; and where each ends."""
    n = size[line]
    upto = np.cumsum(n)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    place = np.repeat((first[line] - (upto - n)).astype(kind), n)
    place += np.arange(total, dtype=kind)
    return flat[place], upto


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, vocabulary: str, path: str, end: int = END, shard_text: int = SHARD_TEXT) -> None:
    """Write the documents' tokens to path: files of one shard each, with the first and last doc_id and the number of tokens."""
    ship(docs.sparkSession)

    def run(batches):
        enc, seq = encoder(vocabulary), 0
        ids, parts, lengths, size = [], [], [], 0

        def shard():
            tokens = np.concatenate(parts)
            made = Shard(list(ids), np.concatenate(lengths), WaveletMatrix.build(tokens, enc.width))
            row = [[ids[0]], [ids[-1]], [seq], [len(ids)], [len(tokens)], [made.to_bytes()]]
            ids.clear(), parts.clear(), lengths.clear()
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["first_doc", "last_doc", "seq", "n_docs", "n_tokens", "payload"])

        for b in batches:
            letters = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(letters, dtype=np.int64) // max(1, min(TOGETHER, shard_text // 2))
            alone = np.flatnonzero(letters > shard_text // 2)  # long documents are groups, so that they don't make a shard longer than need be
            edges = sorted({0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), *alone.tolist(), *(alone + 1).tolist(), b.num_rows})
            for i, j in zip(edges, edges[1:], strict=False):
                few, more = b.slice(i, j - i), int(letters[i:j].sum())
                if ids and size + more > shard_text:
                    yield shard()
                    seq, size = seq + 1, 0
                tokens, n = enc.encode(few.column(1), [end])
                ids += few.column(0).to_pylist()
                parts.append(tokens)
                lengths.append(n)
                size += more
        if ids:
            yield shard()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = rows.mapInArrow(run, "first_doc long, last_doc long, seq int, n_docs long, n_tokens long, payload binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """One row a document of the files at path: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    table = spark.read.parquet(path)
    key = F.concat_ws(":", F.coalesce(F.col("first_doc").cast("string"), F.lit("-")), F.coalesce(F.col("last_doc").cast("string"), F.lit("-")), F.col("seq").cast("string"))
    starts = offsets(table.select("first_doc", "last_doc", "seq", "n_tokens", key.alias("at")), ["first_doc", "last_doc", "seq"], "n_tokens", "before").select("at", "before")  # a row a shard

    def run(batches):
        for b in batches:
            for at, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard.from_bytes(raw.as_py())
                tokens = shard.matrix.decode().astype("<u4")
                ends = np.cumsum(shard.lengths, dtype=np.int64)
                begin, view = ends - shard.lengths, memoryview(tokens)
                crc = [zlib.crc32(view[i:j]) for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]
                n = len(shard.doc_ids)
                cols = [pa.array([at] * n, pa.string()), pa.array(shard.doc_ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(shard.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["at", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = table.select(key.alias("at"), "payload").mapInArrow(run, "at string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    joined = rows.join(broadcast_if_small(starts, MAX_SMALL), "at")
    return joined.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(docs.sparkSession)}/jobtide-ids-{uuid.uuid4().hex}"
    write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_shards(docs.sparkSession, path)
