import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pkgsieve.llm import wavelet as W
from pkgsieve.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, edge_rows

WHOLE = Tokenizer.from_file(tokenizer_path())


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


ENCODER = W.WordEncoder(tokenizer_path(), limit=300)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([
    "Dog's.", "can't...", "<|endoftext|>", "<|EndOfText|>,", "é", " ́", "x y", " ", "ÅΣς.", "a,b", "9."])), max_size=12),
    st.sampled_from([" ", "\n", "\t ", ""]))
def test_words_encode_as_the_whole_text(parts, glue):
    text = glue.join(parts).encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODER.encode([text.encode()])[0], dtype="<u4").tolist() == whole(text)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 70_001])
def test_shard_round_trip_and_lookups(n):
    rnd = random.Random(n)
    ids = np.array([rnd.choice([1, 7, 49_000, rnd.randrange(49_408)]) for _ in range(n)], dtype=np.uint32)
    file = io.BytesIO()
    W.write_shard(file, ids, [5, None], [n, 0])
    file.seek(0)
    shard = W.Shard(file)
    assert shard.documents()[0] == [5, None] and shard.documents()[1].tolist() == [n, 0]
    for i in rnd.sample(range(n), min(n, 30)):
        assert shard.access(i) == ids[i]
    for token in (1, 7, 49_000, 3, 1 << 20):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        for k in range(0, len(places), max(1, len(places) // 7)):
            assert shard.select(token, k) == places[k] and shard.rank(token, int(places[k])) == k
        with pytest.raises(IndexError):
            shard.select(token, len(places))
    assert (shard.ids() == ids).all()


def test_wide_ids():
    ids = np.array([0, 200_000, 70_000, 200_000], dtype=np.uint32)
    file = io.BytesIO()
    W.write_shard(file, ids, [1], [4])
    file.seek(0)
    assert (W.Shard(file).ids() == ids).all()


def want(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*whole(text), 1], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in QUERIES["op1_wavelet_tokens"](spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(rows) == want(sorted(tuple(r) for r in source))


def test_edges_and_many_shards(spark):
    df = docs(spark, edge_rows(), clash=True)
    table = W.write_shards(df, tokenizer_path(), shard_tokens=20)
    assert table.count() > 4
    got = sorted((tuple(r) for r in W.read_shards(table).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in edge_rows()), key=lambda d: (d is not None, d or 0))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in want([(r[0], r[1]) for r in edge_rows()]))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()


def test_empty_table(spark):
    assert W.encode_corpus(docs(spark, []), tokenizer_path()).count() == 0


def test_texts_are_cut_into_words_once(monkeypatch):
    import public_tokenizers

    from pkgsieve.llm import wavelet

    texts, cuts = [b"one two, three", b"", "zwei drei ä.".encode()], []
    plain = wavelet.word_pieces
    monkeypatch.setattr(wavelet, "word_pieces", lambda t: cuts.append(t) or plain(t))
    path = public_tokenizers.path("word_bpe_49k.json")
    held = wavelet.WordEncoder(path).encode(texts)
    assert len(cuts) == len(texts)
    monkeypatch.setattr(wavelet, "GROUP_BYTES", 1)  # as for a text too long to be held cut up
    assert wavelet.WordEncoder(path).encode(texts) == held


def test_plain_words_go_to_the_model_alone():
    text = "Straße ÉTÉ x2y, a,b!! zwei** 42 É. ñandú"
    encoder = W.WordEncoder(tokenizer_path())
    others = W.WordEncoder(tokenizer_path())
    others.shown = {}  # as for a vocabulary with other steps
    encoder.tokenizer = None
    found = encoder.encode([text.encode()])
    assert np.frombuffer(found[0], dtype="<u4").tolist() == whole(text) and others.encode([text.encode()]) == found


def test_words_are_forgotten_after_two_generations():
    encoder = W.WordEncoder(tokenizer_path(), limit=3)
    first = encoder.encode([b"one two three four"])
    assert not encoder.words and set(encoder.words.old) == {b"one", b"two", b"three", b"four"}
    assert encoder.encode([b"one two three four"]) == first
    encoder.encode([b"five six seven eight"])
    assert b"one" not in encoder.words.old and not encoder.words.old.old
