"""Deleted interpolation: a bigram language model over the whole corpus.

P(w | v) = a[b] c(v,w)/c(v) + d[b] c(w)/N + e[b] / (V + 1), where b is the
bucket (power of two) of the context's count c(v); the weights of each bucket
are learned by expectation-maximisation on a deleted part of the training
documents, with the counts of the rest; the score uses the counts of all.

Counts never visit the driver and no count table is broadcast.  Documents are
packed into batches of about ``BATCH_TOKENS`` tokens.  A batch asks for the counts of
its distinct words and bigrams: one row per batch and part of the hash space,
with the batch's own counts, holding sorted 64-bit hashes as differences.  A part
adds up what all batches sent (a frequent bigram is one entry per batch) and
answers each batch in the order it asked.  A batch then has the counts of
all its tokens side by side.

    batches -> requests -(part)-> answers -(batch)-> held-out counts -> EM
                                           -(batch)-> scores

Defined cases: a null text is empty: one end token; a null doc_id is a
training document; repeated rows count each; without a deleted part the
weights are equal; without training documents only 1 / (V + 1) is left, V = 0;
an empty table gives an empty result; a long text is a batch of its own and
worked on whole; columns of other names are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textops import word_pieces

BATCH_TOKENS = 1_200_000
TOKENS_PER_PART = 1_000_000
LEAST_PARTS = 64
BUCKETS = 48
TOLERANCE = 1e-3
FLOOR = 1e-5
END, BEGIN = 0, 1  # places of the marks in a batch's words
MARKS = (b"\nend", b"\nbegin")  # no word has white space
TEST, DELETED, KEPT = 0, 1, 2
BATCH = ("batch long, deleted boolean, doc_ids array<long>, folds array<int>, lengths array<int>, "
         "words binary, tokens binary, n_tokens long")


def _pack(a: np.ndarray) -> bytes:
    """An array by its bytes' places (the high ones are mostly zero), compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, "<u8"), dtype=np.uint64)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Pack:
    """Documents gathered for a batch."""

    def __init__(self):
        self.place = {MARKS[END]: END, MARKS[BEGIN]: BEGIN}
        self.tokens: list[np.ndarray] = []
        self.doc_ids: list = []
        self.folds: list[int] = []
        self.lengths: list[int] = []
        self.held = 0

    def add(self, doc_id, fold: int, text: bytes) -> None:
        before, place = self.held, self.place
        for words in word_pieces(text.lower()):
            for w in dict.fromkeys(words):
                if w not in place:
                    place[w] = len(place)
            self.tokens.append(np.fromiter(map(place.__getitem__, words), dtype="<u4", count=len(words)))
            self.held += len(words)
        self.tokens.append(np.array([END], dtype="<u4"))
        self.held += 1
        self.doc_ids.append(doc_id)
        self.folds.append(fold)
        self.lengths.append(self.held - before)

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        hashes = np.fromiter(map(word_hash, self.place), dtype="<u8", count=len(self.place))
        return pa.RecordBatch.from_pydict({
            "batch": [number], "deleted": [self.folds[0] == DELETED], "doc_ids": [self.doc_ids], "folds": [self.folds],
            "lengths": [self.lengths], "words": [_pack(hashes)], "tokens": [_pack(np.concatenate(self.tokens))],
            "n_tokens": [self.held]}, schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a plain column list (tasks have no Spark session to ask)."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def batches(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The written table of batches of rows (doc_id, fold, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), "fold", F.coalesce("text", F.lit("")).alias("text"),
                       F.spark_partition_id().cast("long").alias("part"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(BATCH)
        packs: dict[bool, _Pack] = {}
        number, base = 0, 0
        for part in parts:
            for doc_id, fold, text, p in zip(*part.columns):
                base, fold = p.as_py() << 32, fold.as_py()
                pack = packs.setdefault(fold == DELETED, _Pack())
                pack.add(doc_id.as_py(), fold, text.as_buffer().to_pybytes())
                if pack.held >= batch_tokens:
                    yield packs.pop(fold == DELETED).batch(base + number, schema)
                    number += 1
        for pack in packs.values():
            yield pack.batch(base + number, schema)
            number += 1

    return cut(rows.mapInArrow(run, BATCH))


class _Batch:
    """A batch opened: tokens, contexts, and its distinct bigrams by hash."""

    def __init__(self, row: dict):
        self.row = row
        self.words, self.tokens = _unpack(row["words"], "<u8"), _unpack(row["tokens"], "<u4")
        self.lengths = np.array(row["lengths"], dtype=np.int64)
        self.folds = np.array(row["folds"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.context = np.roll(self.tokens, 1)
        self.context[self.starts] = BEGIN
        pairs = _pair_hash(self.words[self.context], self.words[self.tokens])
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)

    def per_token(self, flag: np.ndarray) -> np.ndarray:
        return np.repeat(flag, self.lengths)

    def asked(self, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """kind -> (hashes, their order by part then hash, part bounds in that order)."""
        out = {}
        for kind, keys in ((1, self.words), (2, self.pairs)):
            part = keys % np.uint64(parts)
            order = np.lexsort((keys, part))
            out[kind] = keys, order, np.searchsorted(part[order], np.arange(parts + 1))
        return out


def _opened(table: pa.Table) -> Iterator[_Batch]:
    for row in table.to_pylist():
        yield _Batch(row)


REQUEST = "part int, batch long, deleted boolean, kind int, keys binary, train binary, kept binary"


def requests(packed: DataFrame, parts: int) -> DataFrame:
    """What the batches ask for, with what they add: (part, batch, kind, ...)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(REQUEST)
        for table in tables:
            for b in _opened(table):
                train, kept = b.folds != TEST, b.folds == KEPT
                own = {}
                for name, flag in (("train", train), ("kept", kept)):
                    weight = b.per_token(flag)
                    words = np.bincount(b.tokens[weight], minlength=len(b.words))
                    words[BEGIN] = np.count_nonzero(flag)
                    own[name] = {1: words, 2: np.bincount(b.pair_of[weight], minlength=len(b.pairs))}
                rows = []
                for kind, (keys, order, bounds) in b.asked(parts).items():
                    for part in np.flatnonzero(np.diff(bounds)).tolist():
                        at = order[bounds[part]:bounds[part + 1]]
                        rows.append({"part": part, "batch": b.row["batch"], "deleted": b.row["deleted"], "kind": kind,
                                     "keys": _pack_sorted(keys[at]), **{n: _pack(own[n][kind][at].astype("<u4")) for n in own}})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packed.mapInArrow(run, REQUEST)


ANSWER = "batch long, kind int, part int, train binary, kept binary, n long, n_kept long, v long, v_kept long"


def answers(asked: DataFrame) -> DataFrame:
    """Written (batch, kind, part, counts): for every request the corpus
    counts of its keys, in its order; kind 0 rows hold a part's share of the
    totals N and V.  Counts of the kept part go to deleted batches only."""

    def run(table: pa.Table) -> pa.Table:
        schema = _arrow_schema(ANSWER)
        out, begin = [], np.uint64(word_hash(MARKS[BEGIN]))
        rows = table.to_pylist()
        for kind in (1, 2):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            lists = [_unpack_sorted(r["keys"]) for r in own]
            keys, place = np.unique(np.concatenate(lists), return_inverse=True)
            total = {n: np.bincount(place, np.concatenate([_unpack(r[n], "<u4") for r in own]), len(keys)).astype("<u8")
                     for n in ("train", "kept")}
            ends = np.cumsum([len(x) for x in lists])
            for r, a, b in zip(own, [0, *ends.tolist()], ends.tolist()):
                out.append({"batch": r["batch"], "kind": kind, "part": r["part"], "train": _pack(total["train"][place[a:b]]),
                            "kept": _pack(total["kept"][place[a:b]]) if r["deleted"] else None})
            if kind == 1:
                token = keys != begin
                t, k = total["train"][token], total["kept"][token]
                out.append({"batch": -1, "kind": 0, "part": own[0]["part"], "n": int(t.sum()), "n_kept": int(k.sum()),
                            "v": int(np.count_nonzero(t)), "v_kept": int(np.count_nonzero(k))})
        return pa.Table.from_pylist(out, schema=schema)

    return cut(asked.groupBy("part").applyInArrow(run, ANSWER))


def _counts(b: _Batch, found: list[dict], name: str, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus counts of the batch's words and bigrams."""
    out = []
    for kind, (keys, order, _) in b.asked(parts).items():
        rows = sorted((r for r in found if r["kind"] == kind), key=lambda r: r["part"])
        counts = np.zeros(len(keys), dtype=np.uint64)
        counts[order] = np.concatenate([_unpack(r[name], "<u8") for r in rows])
        out.append(counts.astype(np.float64))
    return out[0], out[1]


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count)), at most the last."""
    return np.minimum(np.frexp(count)[1], BUCKETS - 1)


def _with_answers(packed: DataFrame, found: DataFrame):
    return packed.groupBy("batch").cogroup(found.where("kind > 0").groupBy("batch"))


def deleted_counts(packed: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """Written (bucket, c_pair, c_context, c_word, n): tokens of the deleted part
    with equal counts in the kept part."""
    kind = "bucket int, c_pair double, c_context double, c_word double, n long"

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        rows = [_arrow_schema(kind).empty_table()]
        for b in _opened(table):
            words, pairs = _counts(b, counts.to_pylist(), "kept", parts)
            each = np.stack([pairs[b.pair_of], words[b.context], words[b.tokens]], axis=1)
            same, n = np.unique(each, axis=0, return_counts=True)
            rows.append(pa.table([pa.array(_bucket(same[:, 1]).astype(np.int32)), *map(pa.array, same.T.copy()), pa.array(n)],
                                 schema=_arrow_schema(kind)))
        return pa.concat_tables(rows)

    each = _with_answers(packed.where("deleted"), found.where(F.col("kept").isNotNull())).applyInArrow(run, kind)
    return cut(each.groupBy("bucket", "c_pair", "c_context", "c_word").agg(F.sum("n").alias("n")))


def learn_weights(held_out: DataFrame, n: int, v: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """(buckets, 3) weights of bigram, word and uniform estimates, by EM: each
    round is one aggregate over the held-out counts, a row per bucket."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    f = [F.when(F.col("c_context") > 0, F.col("c_pair") / F.col("c_context")).otherwise(0.0),
         F.col("c_word") / F.lit(float(max(n, 1))), F.lit(1.0 / (v + 1))]
    seen = np.zeros(BUCKETS, dtype=bool)
    while True:
        terms = [F.get(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("bucket")) * f[k] for k in range(3)]
        whole = terms[0] + terms[1] + terms[2]
        sums = held_out.groupBy("bucket").agg(*[F.sum(F.col("n") * t / whole).alias(f"s{k}") for k, t in enumerate(terms)])
        new = weights.copy()
        for r in sums.collect():
            s = np.array([r["s0"], r["s1"], r["s2"]])
            new[r["bucket"]] = s / s.sum()
            seen[r["bucket"]] = True
        change = np.abs(new - weights).max()
        weights = new
        if change < tolerance:
            break
    for k in range(1, BUCKETS):  # a bucket without held-out tokens takes the weights of the one below
        if not seen[k] and seen[k - 1] and k > 1:
            weights[k], seen[k] = weights[k - 1], True
    weights[0, 0] = 0.0
    weights = np.maximum(weights, [0.0, FLOOR, FLOOR])
    return weights / weights.sum(axis=1, keepdims=True)


SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(packed: DataFrame, found: DataFrame, parts: int, n: int, v: int, weights: np.ndarray) -> DataFrame:
    """One row per document, from the counts of all training documents."""

    def run(table: pa.Table, counts: pa.Table) -> pa.Table:
        rows = [_arrow_schema(SCORE).empty_table()]
        for b in _opened(table):
            words, pairs = _counts(b, counts.to_pylist(), "train", parts)
            own, context = words[b.tokens], words[b.context]
            bucket = _bucket(context)
            p = weights[bucket, 0] * pairs[b.pair_of] / np.maximum(context, 1)
            p += weights[bucket, 1] * own / max(n, 1) + weights[bucket, 2] / (v + 1)
            base = np.log10((own + 0.1) / (n + 0.1 * (v + 1)))
            per_doc = lambda x: np.add.reduceat(x, b.starts)
            rows.append(pa.table([pa.array(b.row["doc_ids"], pa.int64()), pa.array(b.folds == TEST), pa.array(b.lengths),
                                  pa.array(per_doc((own > 0).astype(np.int64))), pa.array(np.full(len(b.lengths), n)),
                                  pa.array(per_doc(base)), pa.array(per_doc(np.log10(p)))], schema=_arrow_schema(SCORE)))
        return pa.concat_tables(rows)

    return _with_answers(packed, found).applyInArrow(run, SCORE)


def score_corpus(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Score rows (doc_id, fold, text); ``fold`` is TEST, DELETED or KEPT."""
    packed = batches(docs, batch_tokens)
    tokens = packed.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(LEAST_PARTS, -(-tokens // TOKENS_PER_PART))
    found = answers(requests(packed, parts))
    t = found.where("kind = 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_kept", "v", "v_kept")]).first()
    weights = learn_weights(deleted_counts(packed, found, parts), t["n_kept"], t["v_kept"])
    return scores(packed, found, parts, t["n"], t["v"], weights)
