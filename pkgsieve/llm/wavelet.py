"""Token ids in wavelet-matrix shard files.

A shard holds the token ids of consecutive documents.  Bit k (from the top) of
all ids, in the order made by a stable sort on the bits above, is plane k; the
planes answer access, rank, count and select without the ids themselves.

File: ``WVM1``, the header's length (u32), a JSON header, then the sections
that the header places, each zstd-compressed: per plane its bits (u64 words,
lowest bit first) and the ones before every 64th word (u32), and the documents
(ids, nulls, token counts).  Numbers are little-endian.

Documents are range-partitioned and sorted by doc_id (nulls first, equal ids
by a hash of the text); a task streams its range into shards of about
``SHARD_TOKENS`` tokens.  A table written at the end names the files; readers
use nothing else.

Defined cases: a null text is empty and holds the end id alone; repeated rows
are encoded each; an empty table makes no file; columns of other names are not
read.  A document never spans two
shards, so one longer than ``SHARD_TOKENS`` makes a longer shard.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .common import cut
from .textops import word_pieces

SHARD_TOKENS = 1 << 21
CACHED_WORDS = 600_000
ROWS_PER_TASK = 1 << 16
GROUP_BYTES = 1 << 21
SAMPLE = 64  # words of a plane between two rank samples
MAGIC = b"WVM1"
# the characters of plain words: letters that NFC leaves alone, digits, and marks but for the apostrophe
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = [c for c in map(chr, [*range(0x21, 0x7f), *range(0xc0, 0x100)]) if c not in "'×÷"]
_plain = re.compile(f"[!-&(-~{_LETTERS}]+").fullmatch
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+").findall
# the steps before the model for which that holds
_STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}]


class _Words(dict):
    """Ids (little-endian u32) by word; a word not yet known is encoded when it is looked up."""

    def __init__(self, learn: Callable[[bytes], bytes], old: dict[bytes, bytes]):
        super().__init__()
        self.learn, self.old = learn, old

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.old.get(word) or self.learn(word)
        return found


class WordEncoder:
    """Token ids of whole texts by the tokenizers library.

    The vocabulary drops white space and never joins characters across it, so
    a text's ids are those of its words in order; each distinct word is
    encoded once per worker.  Two generations bound the memory: a word seen
    again is carried over, others are forgotten.

    A word of printable ASCII and Latin-1 letters is cut into the runs that the
    tokenizer's pre-tokenizer cuts (letters, single digits, the rest) and these
    go to the library's model directly, mapped character by character as the
    normalizer and the byte-level step map them; any other word, one with an
    apostrophe (its own patterns) or of a vocabulary with other steps goes
    through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel unit
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.shown = self._mapped()
        self.words = _Words(self._learn, {})

    def _mapped(self) -> dict[int, str]:
        """What the model gets for each character of the plain words; empty if the steps before it are others."""
        before, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if before is None or cut is None or [json.loads(x.__getstate__()) for x in (before, cut)] != _STEPS:
            return {}
        return {ord(c): cut.pre_tokenize_str(before.normalize_str(c))[0][0] for c in _PLAIN}

    def encode(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        get = self.words.__getitem__
        # the vocabulary is lower case; special tokens are not folded
        out = [b"".join([b"".join(map(get, words)) for words in word_pieces(t if b"<|" in t else t.lower())]) for t in texts]
        if len(self.words) > self.limit:
            self.words.old = {}
            self.words = _Words(self._learn, self.words)
        return out

    def _learn(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not self.shown or b"<|" in word or not _plain(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        runs = _RUNS(text)
        if len(runs) > 1:
            return b"".join([self.words[run.encode()] for run in runs])
        return array("I", [t.id for t in self.model.tokenize(text.translate(self.shown))]).tobytes()


def _groups(rows: Iterable[tuple], size: int) -> Iterator[list[tuple]]:
    """Runs of (doc_id, text) of about ``size`` bytes, at least one each."""
    group: list[tuple] = []
    held = 0
    for row in rows:
        group.append(row)
        held += len(row[1])
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def build(ids: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """The planes (u64 words) of ``ids`` and the zeros of each."""
    top = max(1, int(ids.max(initial=0)).bit_length())
    ids = ids.astype(np.uint16 if top <= 16 else np.uint32)
    planes, zeros = [], []
    for k in range(top - 1, -1, -1):
        ones = (ids >> ids.dtype.type(k)) & ids.dtype.type(1) != 0
        packed = np.packbits(ones, bitorder="little")
        planes.append(np.pad(packed, (0, -len(packed) % 8)).view("<u8"))
        zeros.append(int(len(ids) - np.count_nonzero(ones)))
        if k:
            ids = np.concatenate([ids[~ones], ids[ones]])
    return planes, zeros


def write_shard(out, ids: np.ndarray, doc_ids: list, counts: list[int]) -> None:
    planes, zeros = build(ids)
    pack = zstandard.ZstdCompressor(level=1).compress
    sections = []
    for p in planes:
        sections.append(pack(p.tobytes()))
        before = np.cumsum(np.bitwise_count(p), dtype=np.uint64) - np.bitwise_count(p)
        sections.append(pack(before[::SAMPLE].astype("<u4").tobytes()))
    none = np.array([d is None for d in doc_ids], dtype=np.uint8)
    named = np.array([d or 0 for d in doc_ids], dtype="<i8")
    sections += [pack(named.tobytes()), pack(none.tobytes()), pack(np.array(counts, dtype="<u4").tobytes())]
    header = json.dumps({"n": len(ids), "planes": len(planes), "zeros": zeros, "docs": len(doc_ids),
                         "sections": [len(s) for s in sections]}).encode()
    out.write(MAGIC + len(header).to_bytes(4, "little") + header)
    for s in sections:
        out.write(s)


class Shard:
    """A shard file; sections are read when they are first asked for."""

    def __init__(self, file):
        self.file = file
        head = file.read(8)
        if head[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(head[4:], "little")
        header = json.loads(file.read(size))
        self.n, self.zeros = header["n"], header["zeros"]
        ends = np.cumsum([8 + size, *header["sections"]])
        self.places = list(zip(ends.tolist(), header["sections"]))
        self.held: dict[int, np.ndarray] = {}

    def _section(self, k: int, kind: str) -> np.ndarray:
        if k not in self.held:
            at, size = self.places[k]
            self.file.seek(at)
            self.held[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(size)), dtype=kind)
        return self.held[k]

    def plane(self, k: int) -> np.ndarray:
        return self._section(2 * k, "<u8")

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane ``k`` before place ``i``."""
        word = i >> 6
        words, samples = self.plane(k), self._section(2 * k + 1, "<u4")
        s = min(word // SAMPLE, len(samples) - 1) if len(samples) else 0
        ones = int(samples[s]) + int(np.bitwise_count(words[s * SAMPLE:word]).sum()) if len(samples) else 0
        return ones + (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else ones

    def _bit(self, k: int, i: int) -> int:
        return int(self.plane(k)[i >> 6]) >> (i & 63) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for k, zeros in enumerate(self.zeros):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where ``token``'s occurrences within [a, b) end up below the last plane."""
        if token >> len(self.zeros):
            return 0, 0
        for k, zeros in enumerate(self.zeros):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (zeros + x, zeros + y) if token >> (len(self.zeros) - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of ``token`` in places [a, b)."""
        first, last = self._range(token, a, self.n if b is None else b)
        return last - first

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def select(self, token: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``token``."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for p in range(len(self.zeros) - 1, -1, -1):
            one = i >= self.zeros[p]
            i = self._nth(p, i - self.zeros[p] if one else i, one)
        return i

    def _nth(self, k: int, nth: int, one: bool) -> int:
        """The place of the ``nth`` one or zero of plane ``k``, by bisection over rank."""
        low, high = 0, self.n
        while high - low > 1:
            mid = (low + high) // 2
            before = self._ones(k, mid)
            if (before if one else mid - before) <= nth:
                low = mid
            else:
                high = mid
        return low

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        values = np.zeros(self.n, dtype=np.uint32)
        for k in range(len(self.zeros) - 1, -1, -1):
            one = np.unpackbits(self.plane(k).view(np.uint8), count=self.n, bitorder="little").view(bool)
            low = len(self.zeros) - 1 - k
            above = np.empty_like(values)
            above[~one] = values[: self.zeros[k]]
            above[one] = values[self.zeros[k]:] | np.uint32(1 << low)
            values = above
            self.held.pop(2 * k, None)
        return values

    def documents(self) -> tuple[list, np.ndarray]:
        """(ids, token counts) of the documents in order."""
        at = 2 * len(self.zeros)
        ids, none = self._section(at, "<i8"), self._section(at + 1, "u1")
        return [None if x else int(d) for d, x in zip(ids, none)], self._section(at + 2, "<u4")


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode (doc_id, text), write the shard files and return the written
    table of them: (part, seq, uri, n_docs, n_tokens), in document order."""
    folder = store.new_folder(docs.sparkSession, "wavelet")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // ROWS_PER_TASK))
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = (docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(tasks, *order)
                .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, names, counts, held, part, seq = encoder(tokenizer_path), [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            uri, out = store.create(folder, f"{part:06d}-{seq:06d}.wvm")
            with out:
                write_shard(out, np.frombuffer(b"".join(ids), dtype="<u4"), names, counts)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(names)],
                                               "n_tokens": [held]}, schema=schema)

        for batch in batches:
            part = batch.column("part")[0].as_py()
            rows = ((d.as_py(), t.as_buffer().to_pybytes() if t.is_valid else b"")
                    for d, t in zip(batch.column("doc_id"), batch.column("text")))
            for group in _groups(rows, GROUP_BYTES):
                for (doc_id, _), found in zip(group, words.encode(t for _, t in group)):
                    ids.append(found + end)
                    names.append(doc_id)
                    counts.append(len(ids[-1]) // 4)
                    held += counts[-1]
                    if held >= shard_tokens:
                        yield shard()
                        ids, names, counts, held, seq = [], [], [], 0, seq + 1
        if names:
            yield shard()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()),
                        ("n_tokens", pa.int64())])
    return cut(rows.mapInArrow(write, "part int, seq int, uri string, n_docs long, n_tokens long"))


def with_starts(shards: DataFrame) -> DataFrame:
    """Add ``start``: tokens before the shard.  Shards are summed per task's
    range first; the window without keys has a row per range."""
    ranges = shards.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    local = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(local), F.lit(0))
    return shards.withColumn("start", inside).join(ranges, "part").withColumn("start", F.col("start") + F.col("base")).drop("base")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input(uri) as file:
                    shard = Shard(file)
                    names, counts = shard.documents()
                    raw = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(counts, dtype=np.int64)
                begins = ends - counts
                crcs = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(begins + start), pa.array(counts.astype(np.int64)),
                     pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.spread(with_starts(shards).select("uri", "start")).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_corpus(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` and describe every document from the files read back."""
    return read_shards(write_shards(docs, tokenizer_path, end_id))
