"""The registered queries themselves on the smallest table: columns, types and laws of the contract."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from psephos.llm import queries

COLUMNS = {
    "op1_lm_scoring": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_decontamination": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op5_sentencepiece": {"doc_id": "bigint", "sample": "int", "round_trip": "boolean", "inclusion": "double"},
    "op6_media_columns": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_quality": {"doc_id": "bigint", "log_ratio": "double", "gumbel_key": "double", "selected": "boolean"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_secret_scan": {"doc_id": "bigint", "candidate_sha256": "string", "probability": "double", "is_secret": "boolean"},
    "op10_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
}
#: Queries with one row for each document.
WHOLE = ["op1_lm_scoring", "op2_language_id", "op6_media_columns", "op7_quality", "op8_simhash", "op10_sharding"]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in queries.documents(spark, sf_dir).select("doc_id", "text").collect()}


def crc(x, m):
    return zlib.crc32(str(x).encode()) % m


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf_dir, texts, name):
    df = queries.QUERIES[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    ids = [r.doc_id for r in rows]
    assert set(ids) <= set(texts)
    if name in WHOLE:
        assert sorted(ids) == sorted(texts)
    if name == "op1_lm_scoring":
        assert all(r.held_out == (crc(r.doc_id, 7) == 2) and r.n_tokens == len(texts[r.doc_id].encode().split()) + 1 for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
    if name == "op2_language_id":
        lang = {r.doc_id: r.lang for r in queries.documents(spark, sf_dir).select("doc_id", "lang").collect()}
        held = [r for r in rows if r.held_out and lang[r.doc_id]]
        assert all(r.held_out == (crc(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    if name == "op5_sentencepiece":
        assert set(ids) == set(texts) and all(r.round_trip and 0 <= r.inclusion <= 1 for r in rows)
    if name == "op6_media_columns":
        for r in rows:
            b = texts[r.doc_id].encode()
            padded = b + bytes(-len(b) % 64 or 64 * (not b))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    if name == "op7_quality":
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
        good = [r.selected for r in rows if labels.get(r.doc_id) == 1]
        poor = [r.selected for r in rows if labels.get(r.doc_id) == 0]
        assert sum(good) >= 0.85 * len(good)  # forty labelled documents to learn from
        assert sum(r.selected for r in rows) < len(rows) and good and poor
    if name == "op8_simhash":
        least = defaultdict(list)
        for r in rows:
            assert len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0
            least[r.component_id].append(r.doc_id)
        assert all(min(v) == k for k, v in least.items())
        same = defaultdict(set)
        for r in rows:
            same[texts[r.doc_id]].add(r.component_id)
        assert all(len(v) == 1 for v in same.values())
    if name == "op9_secret_scan":
        planted = {(i, hashlib.sha256(t.split('token = "')[1].split('"')[0].encode()).hexdigest()) for i, t in texts.items() if 'token = "' in t}
        assert planted <= {(r.doc_id, r.candidate_sha256) for r in rows if r.is_secret}
    if name == "op10_sharding":
        slots = defaultdict(list)
        for r in rows:
            assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()), "key") and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_brute_force_components(spark, sf_dir):
    rows = queries.QUERIES["op8_simhash"](spark, sf_dir).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in ids}
