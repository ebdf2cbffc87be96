"""Encoding, packing and training order."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civitally.llm import bpe, bytebpe, packing, training_order

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = ids_of(library, text)
    for codec in (bytebpe.prefix_codec(), bytebpe.rank_codec()):
        packed = codec.encode(text)
        assert list(array("I", packed)) == want
        assert codec.decode(packed).decode() == library.decode(want, skip_special_tokens=False)


def test_words_of_merged_parts(library):
    rng = random.Random(5)
    vocabulary = bytebpe.vocabulary(None)
    tokens = [t for t in vocabulary.whole if vocabulary.bytes[t].isalpha()]
    words = ["".join(vocabulary.bytes[t].decode("latin-1") for t in rng.choices(tokens, k=4))
             for _ in range(3000)]
    encode = bytebpe.prefix_codec().encode
    assert all(list(array("I", encode(w))) == ids_of(library, w) for w in words)


def test_round_trip_of_odd_rows(odd, library):
    got = sorted(bpe.round_trip(odd).collect(), key=str)
    want = []
    for doc_id, text, *_ in ODD:
        ids = ids_of(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_decode_gives_the_texts_back(odd):
    got = bpe.decode(bpe.encode(odd)).collect()
    want = [(i, t or "") for i, t, *_ in ODD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(none):
    assert bpe.round_trip(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert training_order.records(training_order.shards(none)).count() == 0


def packed_well(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_of_odd_rows(odd, library):
    rows = packing.pack_documents(odd, capacity=64).collect()
    packed_well(rows, 64)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in ODD:
        ids = ids_of(library, text) + [0]
        found = {r["piece"]: r for r in by_id[doc_id]}
        assert sum(r["length"] for r in found.values()) == len(ids)
        assert len(found) == max(1, -(-len(ids) // 64))
        for i, r in found.items():
            part = array("I", ids[r["start"]: r["start"] + r["length"]]).tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            assert r["length"] == 64 or i == 0
    assert len(by_id[6]) == 2  # both rows


@pytest.mark.parametrize("per_task", [40, 300, 100_000])
def test_packing_rounds(spark, per_task):
    rng = random.Random(3)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(400, 700), 1000]) for _ in range(1500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item_id bigint, length bigint")
    placed = packing.pack(items, 1000, per_task).join(items, "item_id").collect()
    assert sorted(r["item_id"] for r in placed) == list(range(1500))
    bins = packed_well(placed, 1000)
    if per_task == 100_000:
        bound = max(-(-sum(sizes) // 1000), sum(s > 500 for s in sizes))
        assert len(bins) <= bound * 1.02 + 1


def test_items_that_do_not_fit_together_end_the_rounds(spark):
    items = spark.range(500).selectExpr("id as item_id", "60L as length")
    placed = packing.pack(items, 100, per_task=20).collect()
    assert len({r["sequence_id"] for r in placed}) == 500


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(total):
    one = training_order.feistel(np.arange(total), total, 7)
    assert sorted(one) == list(range(total))
    if total > 60:
        assert (one != training_order.feistel(np.arange(total), total, 8)).any()


def test_training_order(odd, library, tmp_path):
    made = training_order.shards(odd, key=3, length=32, per_shard=100).cache()
    rows = training_order.records(made, 32, 100).collect()
    want = {}
    for doc_id, text, *_ in ODD:
        ids = ids_of(library, text) + [0]
        for i, at in enumerate(range(0, len(ids), 32)):
            want.setdefault((doc_id, i), []).append(
                zlib.crc32(array("I", ids[at: at + 32]).tobytes()))
    assert sorted(r["slot"] for r in rows) == list(range(sum(map(len, want.values()))))
    assert all((r["shard"], r["byte_offset"]) == (r["slot"] // 100, r["slot"] % 100 * 68)
               for r in rows)
    assert all(r["ids_crc32"] in want[r["doc_id"], r["piece"]] for r in rows)
    first = training_order.write_shards(made, tmp_path.as_uri()).collect()
    again = training_order.write_shards(made, tmp_path.as_uri()).collect()
    assert all(r["written"] for r in first) and not any(r["written"] for r in again)
    one = next(r for r in rows if r["doc_id"] == 4)
    payload = (tmp_path / f"shard-{one['shard']:08d}.bin").read_bytes()
    assert training_order.read_slot(payload, one["slot"] % 100, 32) == ids_of(
        library, "One line only") + [0]


def test_same_order_from_other_partitions(odd):
    rows = lambda d: {(r["slot"], r["doc_id"]) for r in training_order.records(
        training_order.shards(d.coalesce(1), length=64), 64).collect()}
    ordered = odd.orderBy(F.col("doc_id"), "text").coalesce(1)
    assert rows(ordered) == rows(ordered)


def test_width_of_ids(odd):
    ids = np.array([1, 70_000], "<u4")
    with pytest.raises(ValueError, match="70000"):
        training_order.as_width(ids, 2)
    assert training_order.as_width(ids, 4).tolist() == [1, 70_000]
    rows = lambda w: {(r["slot"], r["doc_id"], r["ids_crc32"]) for r in training_order.records(
        training_order.shards(odd.coalesce(1), length=64, id_bytes=w), 64, id_bytes=w).collect()}
    assert rows(2) == rows(4)


def test_packing_of_several_rounds(spark):
    """Many small tasks leave many underfull bins, which rounds merge nearly as well as one task."""
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 800, 3000)
    items = spark.range(len(sizes)).selectExpr(
        "id as item_id", "cast(pmod(xxhash64(id), 799) + 1 as bigint) as length")
    bins = [packing.pack(items, 2048, per_task=n).select("sequence_id").distinct().count()
            for n in (100, 100_000)]
    assert bins[0] <= 1.01 * bins[1] + 1
