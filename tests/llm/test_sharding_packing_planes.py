import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from terraflow.llm import bitplane, packing, sharding
from terraflow.llm.bpe import ChunkEncoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def crc(ids):
    return zlib.crc32(ids.tobytes())


def test_rendezvous(docs, rows):
    got = [r.asDict() for r in sharding.assign(docs, 24).collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({r["doc_id"] for r in got})


def best_shard(key, weights):
    """Straight from the definition: the best of all scores, the smaller shard among equals."""

    def score(shard):
        draw = int(hashlib.md5(f"{key}:{shard}".encode()).hexdigest()[:13], 16)
        return -weights[shard] / math.log((draw + 0.5) / 2**52)

    return max(weights, key=lambda s: (score(s), -s))


def test_every_key_goes_to_its_best_shard(spark):
    keys = [*range(-5, 400), 10**12, None]
    docs = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    for weights in ({s: 1.0 for s in range(24)}, {0: 1.0, 3: 2.5, 7: 0.25}):
        grown = weights | {max(weights) + 1: 1.0}
        for r in sharding.assign(docs, 24, weights=weights).collect():
            key = "null" if r.doc_id is None else r.doc_id
            assert (r.shard, r.grown_shard) == (best_shard(key, weights), best_shard(key, grown)), r.doc_id


def test_weights_and_empty(spark, empty):
    many = spark.range(6000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    n = {r["shard"]: r["count"] for r in sharding.assign(many, 3, weights={0: 1.0, 1: 3.0, 5: 0.0}).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and abs(n[1] - 4500) < 200
    assert sharding.assign(empty, 24).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]) | st.sampled_from(" \n\t\x1c\x85\xa0'sé9."), max_size=30), max_size=6))
def test_chunks_encode_like_whole_texts(texts):
    codec = test_chunks_encode_like_whole_texts.codec
    ids, starts = codec.encode(texts)
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == [*codec.tokenizer.encode(t, add_special_tokens=False).ids, 0]


test_chunks_encode_like_whole_texts.codec = ChunkEncoder(VOCABULARY, chunks=50)


def test_added_tokens_in_texts(spark):
    """The string of an added token is that token, as in the library's plain encode()."""
    plain = Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    assert 50256 in plain.encode(end, add_special_tokens=False).ids
    texts = [f"a {end} b", f" {end}", f"{end}{end} x y\n{end}z", f"one\x1ctwo {end}", "plain words", "<|endof text|> <|endoftext", "words " * 400 + end]
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    digest = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in bitplane.corpus_digest(docs, VOCABULARY).collect()}
    assert digest == {i: (len(x), crc(x)) for i, x in enumerate(want)}
    packed = {r.doc_id: (r.start, r.length, r.ids_crc32) for r in packing.pack(docs, VOCABULARY).collect()}
    assert packed == {i: (0, len(x), crc(x)) for i, x in enumerate(want)}


def test_plan_is_exact_and_small():
    rng = np.random.default_rng(3)
    for total in (50, 5000, 2_000_000):
        counts = np.zeros(2049, np.int64)
        np.add.at(counts, rng.integers(1, 700, 300), total // 300 + 1)
        counts[2048] = 7
        plan = packing.plan(counts, 2048)
        used = np.zeros(2049, np.int64)
        for lengths, times in plan:
            assert sum(lengths) <= 2048 and times > 0
            np.add.at(used, list(lengths), times)
        assert (used == counts).all() and len(plan) < 4096
        least = -(-int((counts * np.arange(2049)).sum()) // 2048)
        assert sum(t for _, t in plan) <= least * 1.02 + 2


def test_pack(docs, rows, reference, empty):
    got = packing.pack(docs, VOCABULARY, 512).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(reference(t))
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    for i, found in ids.items():
        want = Counter()
        for x in found:
            first = len(x) % 512 or 512
            cuts = [0, *range(first, len(x), 512), len(x)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                want[(k, a, b - a, crc(x[a:b]))] += 1
        assert want == Counter((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
    least = max(-(-sum(r.length for r in got) // 512), sum(r.length > 256 for r in got))  # two of over 256 never fit together
    assert len(places) <= least * 1.05 + 1
    assert packing.pack(empty, VOCABULARY).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=40), max_size=8), st.sampled_from(["bit", "byte"]), st.integers(1, 17))
def test_planes_round_trip(documents, unit, block):
    writer, file = bitplane.PlaneWriter(unit, block), io.BytesIO()
    for d in documents:
        for part in writer.add(np.array(d, np.uint32), np.array([len(d)])):
            file.write(part)
    for part in writer.close():
        file.write(part)
    reader = bitplane.PlaneReader(file)
    join = lambda s: np.concatenate([*reader.chunks(s), np.empty(0, np.uint32)]).tolist()
    assert join(0) == [x for d in documents for x in d] and join(1) == [len(d) for d in documents]
    if len(reader.sections[0]) > 1:
        assert reader.chunk(0, 1).tolist() == [x for d in documents for x in d][block : 2 * block]


def test_corpus_digest(docs, rows, reference, empty):
    got = bitplane.corpus_digest(docs, VOCABULARY).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = Counter((i, len(reference(t)), crc(reference(t))) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert bitplane.corpus_digest(empty, VOCABULARY).count() == 0


def test_text_ids_and_broken_bytes(spark, reference):
    rows = [("b", b"two\xffwords"), ("a", None), (None, b"x"), ("", b"y"), ("\u00e9", b"z")]
    odd = spark.createDataFrame(rows, "doc_id string, text binary")
    texts = {i: (t or b"").decode("utf-8", "replace") for i, t in rows}
    got = bitplane.corpus_digest(odd, VOCABULARY).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "", "a", "b", "\u00e9"]
    assert {r.doc_id: r.ids_crc32 for r in got} == {i: crc(reference(t)) for i, t in texts.items()}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(odd, VOCABULARY).collect()} == {i: crc(reference(t)) for i, t in texts.items()}


def test_names_in_files():
    file, writer = io.BytesIO(), bitplane.PlaneWriter("byte", 5)
    names = ["one", None, "", "\u00e9t\u00e9", "1234567"]
    for k, name in enumerate(names):
        for part in writer.add(np.arange(k, dtype=np.uint32), np.array([k]), [name]):
            file.write(part)
    for part in writer.close():
        file.write(part)
    assert [(n, i.tolist()) for n, i in bitplane.PlaneReader(file).documents()] == [(n, list(range(k))) for k, n in enumerate(names)]
