"""Target resampling, packing and spelling variants against plain loops on small tables, and against SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from psephos.llm import packing, queries, spelling, target_resampling

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = "a\x1cb  c \n\n d\t\te   \n f!\x1c\x1d x y  z\x85w don't we'll 12ab,;  .. <|endoftext|> 漢字かな ünï\U0001f600  "


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 19, 20, 40, 300])))) for k in range(60)]
    return out + [(60, None), (61, ""), (62, ODD), (63, "Word, " * 9000), (64, "x" * 5000), (7, "again " * 30), (7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (None, "no id " * 20)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", 0, "y", 1) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int, word string, score int").repartition(3)


def score_of(weight, doc_id):
    h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def features_of(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 35), (1, 0), (1, 100)])
def test_resampling_against_a_plain_loop(spark, docs, texts, longest, percent, monkeypatch):
    monkeypatch.setattr(target_resampling.word_windows, "__defaults__", (50,))  # windows that words and runs cross
    target = spark.createDataFrame([("abc again é",), (None,), ("Word word no id",)], "text string")
    s, t = Counter(), Counter()
    for _, text in texts:
        s.update(features_of(text, longest)[1])
    for (text,) in target.collect():
        t.update(features_of(text, longest)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000)))) for b in s}
    rows = []
    for i, text in texts:
        n, f = features_of(text, longest)
        w = sum(gain[b] for b in f)
        rows.append((i, n, len(f), w, score_of(w, i)))
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    want = Counter((*r, k + 1 if k < percent * len(fit) // 100 else None) for k, r in enumerate(fit)) + Counter((*r, None) for r in rows if r[1] < 20)
    got = target_resampling.resample(docs, target, longest=longest, percent=percent, rows_each=4)
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == want


def test_resampling_of_empty_tables(spark, docs):
    target = spark.createDataFrame([], "text string")
    assert target_resampling.resample(docs.limit(0), target).count() == 0
    assert target_resampling.resample(docs, target).where("rank IS NOT NULL").count() > 0


def test_cut_among_many_ties(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") * 7919 % 1000).alias("b"), F.lit(2).cast("long").alias("copies"))
    order = sorted((x % 3, x * 7919 % 1000) for x in range(1000) for _ in range(2))
    for want in (1, 2, 3, 667, 668, 1999, 2000):
        cut, left = target_resampling.cutoff(rows, ["a", "b"], "copies", want)
        assert tuple(cut) == order[want - 1] and left == 2 - want % 2
    assert target_resampling.cutoff(rows, ["a", "b"], "copies", 0) is None


def test_ids_are_the_tokenizers_own(texts, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "WINDOW", 40)
    own, whole = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = True
    rng = random.Random(3)
    noise = ["".join(rng.choice(" \n\t\x1c\x85 　ab1'.,-é漢s") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    for text in [ODD, *noise, *[t for _, t in texts if t]]:
        assert np.frombuffer(own.encoded(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_packing_laws(docs, texts, block):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    whole.encode_special_tokens = True
    packed = packing.pack(docs, TOKENIZER, length=256, block_tokens=block)
    rows = packed.collect()
    of = defaultdict(list)
    for r in rows:
        of[r.sequence].append((r.offset, len(r.ids) // 4))
    for parts in of.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and not at & (at - 1)  # full, or a power of two
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    for i, ids in want:
        own = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens) for r in rows if r.id == i and r.doc_tokens == len(ids))
        copies = sum(n for (j, x), n in want.items() if j == i and len(x) == len(ids))
        assert sum(len(x) for _, x, _ in own) == copies * len(ids)
        if copies == 1:
            assert [y for _, x, _ in own for y in x] == list(ids) and [s for s, *_ in own] == [0, *itertools.accumulate(len(x) for _, x, _ in own)][:-1]
    filled = packing.sequences(packed, 256).collect()
    assert {r.sequence: r.n_tokens for r in filled} == {s: sum(n for _, n in p) for s, p in of.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in filled)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_sequences_are_padded(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    rows = [(9, 0, ids(5, 6), 3, 1, 0), (9, 2, ids(7), 3, 1, 2), (8, 0, ids(4, 4), 2, 2, 0)]
    got = {r.sequence: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(spark.createDataFrame(rows, "id long, start long, ids binary, doc_tokens long, sequence long, offset long"), 8, pad=3).collect()}
    assert got == {1: [5, 6, 7, 3, 3, 3, 3, 3], 2: [4, 4]}


def test_dealing_against_a_plain_loop():
    rng = random.Random(8)
    for _ in range(30):
        lengths = [rng.choice([1, 3, 9, 40, 64, 65, 200]) for _ in range(rng.randint(0, 60))]
        left = sorted(((n % 64, -k) for k, n in enumerate(lengths) if n % 64), reverse=True)
        bins = [[c, 0.0] for c in packing.capacities(sum(n for n, _ in left), 64)]
        for n, _ in left:
            while n:
                fits = [b for b in bins if b[0] >= n] or [b for b in bins if b[0]]
                b = min(fits, key=lambda b: b[1])
                part = min(n, b[0])
                n, b[0], b[1] = n - part, b[0] - part, b[1] + packing.cost(part, 64)
        got = packing.dealt(lengths, 64)
        spent = defaultdict(float)
        for _, _, n, s, _ in got:
            spent[s] += packing.cost(n, 64)
        assert sorted(spent.values()) == pytest.approx(sorted([b[1] for b in bins] + [packing.cost(64, 64)] * sum(n // 64 for n in lengths)))


def test_costs_are_balanced():
    """Closer together than those of documents of the same lengths that go to the fullest sequence with room."""
    rng = random.Random(2)
    lengths = [min(1000, int(rng.lognormvariate(5, 1)) + 1) for _ in range(20_000)]
    spent, fullest = defaultdict(float), [[c, 0.0] for c in packing.capacities(sum(lengths), 2048)]
    for _, _, n, s, _ in packing.dealt(lengths, 2048):
        spent[s] += packing.cost(n, 2048)
    for n in sorted(lengths, reverse=True):
        while n:
            b = min([b for b in fullest if b[0] >= n] or [b for b in fullest if b[0]])
            part = min(n, b[0])
            n, b[0], b[1] = n - part, b[0] - part, b[1] + packing.cost(part, 2048)
    ours, theirs = ([c for c in x if c > 2048] for x in (spent.values(), [c for _, c in fullest]))
    assert np.std(ours) < 0.5 * np.std(theirs) and max(ours) - min(ours) < 0.5 * (max(theirs) - min(theirs))


def test_a_length_must_be_a_power_of_two(docs):
    with pytest.raises(ValueError):
        packing.pack(docs, TOKENIZER, length=1000)


def brute_variants(texts, min_chars=5, min_count=3, ratio=2, every=97):
    n = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    links = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return out


def variant_texts():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["commons" + c for c in "abcdefghij"] + ["e" * n for n in range(5, 12)] + ["ÀBCDE", "àbcde", "abcdef" * 30, "abcdef" * 29 + "abcde"]
    for w in list(base):  # chains of edits
        for _ in range(3):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
            base.append(w)
    rows = [(k, " ".join(rng.choice(base) if rng.random() < 0.7 else base[int(rng.paretovariate(0.7)) % len(base)] for _ in range(60)) + ("," if k % 2 else " Éclat÷x ")) for k in range(80)]
    return rows + [(None, None), (None, "nullid nullid NULLID"), (3, ""), (4, "12 !?"), (5, "word " * 3000), (5, "word " * 3000)]


@pytest.mark.parametrize("tile, every", [(1 << 20, 97), (200, 97), (200, 2)])
def test_variants_against_brute_force(spark, tile, every, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)
    monkeypatch.setattr(spelling, "WINDOW", 100)
    rows = variant_texts()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {tuple(r) for r in spelling.variants(docs, tile=tile, every=every).collect()}
    want = brute_variants(rows, every=every)
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_a_crowded_block_is_halved_without_loss(spark):
    rng = random.Random(4)
    words = sorted({"shared" + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(1500)} | {"shared" + "".join(rng.choice("abcdef") for _ in range(6)) for _ in range(1500)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    known = set(words)
    want = set()
    for w in words:
        for i in range(len(w) + 1):
            for v in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in "abcdef"), *(w[:i] + c + w[i:] for c in "abcdefshr")}:
                if v in known and v != w:
                    want |= {(w, v), (v, w)}
    blocks = spelling.blocks(table, 5, 20_000)
    assert blocks.groupBy("key", "size", "lo", "hi").count().agg(F.max("count")).first()[0] <= 100
    got = [(r.word, r.other) for r in spelling.near_words(table, 5, 20_000).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_target_resampling", "op13_spelling_variants"])
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, sf_dir)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    assert Counter(map(tuple, want.project(", ".join(order)).fetchall())) == Counter(map(tuple, got.select(*order).collect()))


def test_packing_query(spark, sf_dir):
    got = queries.QUERIES["op12_packing"](spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = got.collect()
    size = defaultdict(int)
    for r in rows:
        size[r.sequence_id] += r.length
    assert all(n <= 2048 and not n & (n - 1) for n in size.values())
    assert {r.doc_id for r in rows} == {r.doc_id for r in queries.documents(spark, sf_dir).select("doc_id").collect()}
