"""Language-model scoring: unigram counts over the whole corpus and a log-bilinear model trained with noise-contrastive estimation.

Tokens are the ASCII-lower-cased words of a text and one end. Words are
factored into frequency classes: the most frequent have one each, the next
share small ones, and so on; the vocabulary grows with the corpus up to the
last band. The model predicts the class of a token from the two before it, of
which a word of a shared class is known by its band: the log-bilinear score of class w is ``(sum_i r[c_i] * C_i) . q[w] +
b[w]``, normalised over all classes by one matrix product for the distinct
contexts of a batch. A word of a shared class has the score ``h . w[word] +
v[word]`` with the same context vector h, normalised over its class by one
matrix product for the class's tokens. Words past the last band are of the
class *other* and have the smoothed share of their count in it, so the
probabilities of all known words and one unknown word sum to one.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import durable, slices

END = b"\n"  # no word holds it
OTHER, STOP = 0, 1  # classes


@dataclass(frozen=True)
class Params:
    """``head_words`` and ``word_bytes`` bound what is broadcast: words with their counts, 12 MB at most.

    ``singles`` words have a class of their own; up to each rank of ``bands``
    classes hold so many words. ``rounds`` is the number of times that groups
    of rows are gone through and their models are averaged; a round of
    ``group_tokens`` times k squared tokens has k groups. ``run_tokens`` is what
    is worked on at once.
    """

    singles: int = 510
    bands: tuple[tuple[int, int], ...] = ((8192, 64), (32_768, 256))
    rounds: int = 2
    within: int = 2  # noise words in a class
    within_rate: float = 0.1
    within_batch: int = 1 << 14  # a multiple of ``batch``
    chunk: int = 1 << 15
    width: int = 16
    noise: int = 50
    rate: float = 0.08
    batch: int = 2048
    seed: int = 11
    head_words: int = 1 << 18
    word_bytes: int = 40
    group_tokens: int = 1 << 17
    run_tokens: int = 1 << 19


def count_tokens(rows: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``(id, text)``; each task counts its batch first."""

    def run(batches):
        for b in slices(batches, 24 << 20):
            seen = Counter()
            for t in b.column(1).to_pylist():
                seen.update(t.lower().split())
            seen[END] += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, p: Params) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, ``p.head_words`` at most: all with a count over a threshold that a histogram gives.

    The histogram has a fixed number of bins of the logarithm of the count, so no sort and no large result is needed.
    """
    short = counts.where(F.octet_length("word") <= p.word_bytes)
    bins = short.groupBy(F.floor(F.log2("n") * 64).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    least, room = None, p.head_words
    for r in sorted(bins.collect(), key=lambda r: -r.bin):
        if r.words > room:
            break
        room, least = room - r.words, r.least
    if least is None:
        return [], np.zeros(0, np.int64)
    found = short.where(F.col("n") >= least).toArrow()
    words, n = found.column("word").to_pylist(), found.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return [words[i] for i in order], n[order].astype(np.int64)


@dataclass
class Layout:
    """Class of each head word, its row among the words of shared classes (-1: none), the rows of each class, and the class that stands for it as a context: the first of its band."""

    kind: np.ndarray
    row: np.ndarray
    first: np.ndarray
    size: np.ndarray
    context: np.ndarray

    @property
    def classes(self) -> int:
        return len(self.size)

    @property
    def rows(self) -> int:
        return int(self.size.sum())


def layout_of(words: list[bytes], p: Params) -> Layout:
    """Classes of the head words in the order of their frequency: *other*, the end, single words, then bands."""
    plain = [i for i, w in enumerate(words) if w != END]
    kind, row = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for i, w in enumerate(words):
        if w == END:
            kind[i] = STOP
    single = plain[: p.singles]
    kind[single] = np.arange(2, 2 + len(single))
    size = [0] * (2 + len(single))
    context = list(range(len(size)))
    at = len(single)
    for top, each in p.bands:
        begin = len(size)
        while at < min(top, len(plain)):
            own = plain[at : min(at + each, top)]
            kind[own], row[own] = len(size), sum(size) + np.arange(len(own))
            size.append(len(own))
            context.append(begin)
            at += len(own)
    return Layout(kind, row, np.cumsum(size) - np.array(size), np.array(size, np.int64), np.array(context))


def unigram(lay: Layout, head_n: np.ndarray, total: int) -> np.ndarray:
    """Smoothed share of each class."""
    n = np.bincount(lay.kind, weights=head_n, minlength=lay.classes)
    n[OTHER] += total - head_n.sum()
    return (n + 1) / (n.sum() + lay.classes)


def start_model(share: np.ndarray, lay: Layout, head_n: np.ndarray, p: Params) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    small = lambda *shape: rng.normal(0, 0.05, shape).astype(np.float32)
    own = np.zeros(lay.rows)
    own[lay.row[lay.row >= 0]] = head_n[lay.row >= 0] + 1.0
    sums = np.repeat(np.add.reduceat(own, lay.first[lay.size > 0]), lay.size[lay.size > 0]) if lay.rows else own
    return {
        "r": small(len(share), p.width), "q": small(len(share), p.width), "c": 1 + small(2, p.width), "b": np.log(share).astype(np.float32),
        "w": np.zeros((lay.rows, p.width), np.float32), "v": np.log(own / np.maximum(sums, 1)).astype(np.float32),
    }


def fit_within(model: dict[str, np.ndarray], grown: dict[str, np.ndarray], h: np.ndarray, rows: np.ndarray, kinds: np.ndarray, lay: Layout, p: Params, rng: np.random.Generator) -> None:
    """One Adagrad step for words of shared classes, in place: each against ``within`` words drawn evenly from its class."""
    size = lay.size[kinds]
    noise = lay.first[kinds][:, None] + (rng.random((len(rows), p.within)) * size[:, None]).astype(np.int64)
    every = np.concatenate([rows[:, None], noise], axis=1)
    score = np.einsum("nd,nkd->nk", h, model["w"][every]) + model["v"][every] - np.log(p.within / size)[:, None]
    error = (1 / (1 + np.exp(-np.clip(score, -30, 30)))).astype(np.float32)
    error[:, 0] -= 1
    if not len(rows):
        return
    order = np.argsort(every.ravel())
    flat, gv = every.ravel()[order], error.ravel()[order]
    heads = np.flatnonzero(np.diff(flat, prepend=-1))
    found, n = flat[heads], np.diff(np.append(heads, len(flat)))
    gw = np.add.reduceat(gv[:, None] * h[order // every.shape[1]], heads)
    gv = np.add.reduceat(gv, heads)
    for k, g in (("w", gw / n[:, None].astype(np.float32)), ("v", gv / n.astype(np.float32))):
        grown[k][found] += g * g
        model[k][found] -= p.within_rate * g / np.sqrt(grown[k][found])


def fit_nce(
    model: dict[str, np.ndarray], share: np.ndarray, before: np.ndarray, target: np.ndarray, p: Params, seed: int, rows: np.ndarray | None = None, lay: Layout | None = None
) -> dict[str, np.ndarray]:
    """One pass of noise-contrastive estimation over tokens in random order, Adagrad steps on minibatches.

    ``before`` is n x 2; ``rows`` has the row of each token in a shared class,
    -1 for the others. The noise classes of a minibatch are shared, so their
    scores are one matrix product.
    """
    rng = np.random.default_rng(seed)
    model = {k: v.copy() for k, v in model.items()}
    r, q, c, b = (model[k] for k in "rqcb")
    classes = len(share)
    grown = {k: np.full_like(v, 1e-2) for k, v in (("r", r), ("q", q), ("c", c), ("b", b))}
    within = {k: np.full_like(model[k], 1e-2) for k in "wv"}
    log_noise = np.log(p.noise * share).astype(np.float32)
    cum = np.cumsum(share)
    d = np.arange(p.width)

    def scatter(index: np.ndarray, g: np.ndarray) -> np.ndarray:
        flat = (index[:, None] * p.width + d).ravel()
        return np.bincount(flat, weights=g.ravel(), minlength=classes * p.width).reshape(classes, p.width)

    def step(name: str, value: np.ndarray, g: np.ndarray, n: int) -> None:
        g = (g / n).astype(np.float32)
        grown[name] += g * g * 1e3
        value -= p.rate * g / np.sqrt(grown[name]) * np.float32(np.sqrt(1e3))

    order = rng.permutation(len(target))
    for at in range(0, len(order), p.batch):
        if lay is not None and rows is not None and at % p.within_batch == 0:
            some = order[at : at + p.within_batch]
            some = some[rows[some] >= 0]
            fit_within(model, within, r[before[some, 0]] * c[0] + r[before[some, 1]] * c[1], rows[some], target[some], lay, p, rng)
        own = order[at : at + p.batch]
        w, c1, c2 = target[own], before[own, 0], before[own, 1]
        r1, r2 = r[c1], r[c2]
        h = r1 * c[0] + r2 * c[1]
        qw = q[w]
        noise = np.minimum(np.searchsorted(cum, rng.random(p.noise)), classes - 1)
        qn = q[noise]
        true = 1 / (1 + np.exp(-((h * qw).sum(1) + b[w] - log_noise[w])))
        false = 1 / (1 + np.exp(-(h @ qn.T + b[noise] - log_noise[noise])))
        e = (true - 1).astype(np.float32)
        dh = e[:, None] * qw + false @ qn
        gq = scatter(w, e[:, None] * h)
        np.add.at(gq, noise, false.T @ h)
        gb = np.bincount(w, weights=e, minlength=classes)
        np.add.at(gb, noise, false.sum(0))
        gr = scatter(c1, dh * c[0]) + scatter(c2, dh * c[1])
        gc = np.stack([(dh * r1).sum(0), (dh * r2).sum(0)])
        n = len(own)
        step("q", q, gq, n)
        step("b", b, gb, n)
        step("r", r, gr, n)
        step("c", c, gc, n)
    return model


def log_probabilities(model: dict[str, np.ndarray], contexts: np.ndarray, classes: int, block: int = 8192) -> np.ndarray:
    """Normalised natural logarithms, contexts x classes, for coded contexts ``c1 * classes + c2``."""
    out = np.empty((len(contexts), classes), np.float32)
    for at in range(0, len(contexts), block):
        x = contexts[at : at + block]
        z = (model["r"][x // classes] * model["c"][0] + model["r"][x % classes] * model["c"][1]) @ model["q"].T + model["b"]
        z -= z.max(1, keepdims=True)
        out[at : at + block] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def token_logs(model: dict[str, np.ndarray], before: np.ndarray, kinds: np.ndarray, classes: int, block: int = 8192) -> np.ndarray:
    """Natural logarithm of each token's class in its context; each distinct context is normalised once, a block of contexts at a time."""
    seen, at = np.unique(before[:, 0] * classes + before[:, 1], return_inverse=True)
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(0, len(seen) + block, block))
    out = np.empty(len(kinds))
    for i in range(len(ends) - 1):
        own = order[ends[i] : ends[i + 1]]
        out[own] = log_probabilities(model, seen[i * block : (i + 1) * block], classes)[at[own] - i * block, kinds[own]]
    return out


def within_logs(model: dict[str, np.ndarray], before: np.ndarray, kinds: np.ndarray, rows: np.ndarray, lay: Layout) -> np.ndarray:
    """Natural logarithm of each token's word in its class and context: one matrix product for the tokens of a class, 0 where the class has one word."""
    out = np.zeros(len(kinds))
    some = np.flatnonzero(rows >= 0)
    order = some[np.argsort(kinds[some], kind="stable")]
    ends = np.append(np.flatnonzero(np.diff(kinds[order])) + 1, len(order)) if len(order) else []
    at = 0
    for end in ends:
        own = order[at:end]
        a, n = lay.first[kinds[own[0]]], lay.size[kinds[own[0]]]
        for part in np.array_split(own, -(-len(own) // 65_536)):
            h = model["r"][before[part, 0]] * model["c"][0] + model["r"][before[part, 1]] * model["c"][1]
            z = h @ model["w"][a : a + n].T + model["v"][a : a + n]
            z -= z.max(1, keepdims=True)
            out[part] = z[np.arange(len(part)), rows[part] - a] - np.log(np.exp(z).sum(1))
        at = end
    return out


def pack(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in "rqcbwv"])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in "rqcbwv":
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def averaged(rows: DataFrame, size: int, p: Params, tasks: int) -> tuple[int, np.ndarray]:
    """Tokens and mean model of ``rows (chunk, n, sums)`` from so many tasks, sums being times n: chunks are added up apart, in two levels, so no task gets a whole model from each other."""
    fan = max(1, int(tasks**0.5))

    def add(table: pa.Table) -> pa.Table:
        every = table.column("sums").combine_chunks()
        every = every.chunk(0) if isinstance(every, pa.ChunkedArray) else every
        total = every.flatten().to_numpy().reshape(table.num_rows, -1).sum(0, dtype=np.float64)
        return pa.table({"chunk": table.column("chunk")[:1], "n": [sum(table.column("n").to_pylist())], "sums": pa.array([total], pa.list_(pa.float64()))})

    dealt = rows.withColumn("part", F.spark_partition_id() % fan)
    n, total = 0, np.zeros(size)
    for r in dealt.groupBy("chunk", "part").applyInArrow(add, "chunk long, n long, sums array<double>").toLocalIterator():
        n += r.n if r.chunk == 0 else 0
        total[r.chunk * p.chunk : r.chunk * p.chunk + len(r.sums)] += r.sums
    return n, total / max(n, 1)


_vocabulary: tuple[str, dict[bytes, int]] = ("", {})


def numbered(words) -> dict[bytes, int]:
    """The head words by number, built once in each Python worker. ``words`` is a broadcast of a name of its own and the words."""
    global _vocabulary
    name, head = words.value
    if _vocabulary[0] != name:
        _vocabulary = (name, {w: i for i, w in enumerate(head)})
    return _vocabulary[1]


def coded(rows: DataFrame, words) -> DataFrame:
    """``row, id, held_out, key, codes, rare`` of ``rows (id, text, held_out)``.

    ``codes`` has the head number of each token (32 bits, ends included, -1: not
    in the head), ``rare`` the words outside the head; ``key`` is a hash of id
    and text, which orders rows alike under any layout. ``row`` numbers them, so
    the result has to be written before it is used twice.
    """

    def run(batches):
        number = numbered(words)
        get, task, serial = number.get, TaskContext.get().partitionId() << 40, 0
        for b in slices(batches, 4 << 20):
            codes, rare = [], []
            for t in b.column(1).to_pylist():
                own = t.lower().split()
                own.append(END)
                found = np.fromiter((get(w, -1) for w in own), np.int32, len(own))
                codes.append(found.tobytes())
                rare.append([own[i] for i in np.flatnonzero(found < 0).tolist()])
            columns = {
                "row": pa.array(task + serial + np.arange(b.num_rows)), "id": b.column(0), "held_out": b.column(2), "key": b.column(3),
                "codes": pa.array(codes, pa.binary()), "rare": pa.array(rare, pa.list_(pa.binary())),
            }
            serial += b.num_rows
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "held_out", key.alias("key")).mapInArrow(run, f"row long, id {kind}, held_out boolean, key long, codes binary, rare array<binary>")


def decoded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Head number of each token, and the tokens of each text."""
    return np.frombuffer(b"".join(codes), np.int32).astype(np.int64), np.array([len(c) // 4 for c in codes], np.int64)


def runs_of(batches, most: int):
    """``group, key, codes`` for each run of a group's texts with ``most`` tokens or just over, wherever the batches end; ``key`` is the first text's."""
    held, n, now, first = [], 0, None, 0
    for b in batches:
        for group, key, codes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if held and (group != now or n >= most):
                yield now, first, held
                held, n = [], 0
            if not held:
                now, first = group, key
            held.append(codes)
            n += len(codes) // 4
    if held:
        yield now, first, held


def contexts_of(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes of the two tokens before each; the end stands before a text."""
    before = np.full((len(kinds), 2), STOP, np.int64)
    before[1:, 0], before[2:, 1] = kinds[:-1], kinds[:-2]
    first = np.cumsum(sizes) - sizes
    before[first] = STOP
    second = (first + 1)[sizes > 1]
    before[second, 1] = STOP
    return before


def train(rows: DataFrame, words, lay: Layout, head_n: np.ndarray, total: int, p: Params) -> dict[str, np.ndarray]:
    """Fits the model on every token of ``rows (key, codes)``.

    Hashes of the key deal the rows to ``rounds`` shares and each share to
    groups. Their number grows with the square root of the tokens, so groups
    become more and larger. A group is gone through in the order of the keys
    from the round's start, and a round ends with the mean of its groups'
    models, weighted by tokens. All of it follows from the rows: how they lie in
    partitions only changes the order in which models are added up.
    """
    spark = rows.sparkSession
    share = unigram(lay, head_n, total)
    model = start_model(share, lay, head_n, p)
    groups = max(1, math.ceil(math.sqrt(total / (p.rounds * p.group_tokens))))
    group = F.pmod(F.xxhash64(F.lit(p.seed), "key"), F.lit(groups)).cast("int").alias("group")
    for i in range(p.rounds):
        shared = spark.sparkContext.broadcast((model, lay, share))

        def run(batches, shared=shared, i=i):
            start, lay, share = shared.value
            every, sums, now, model, n = 0, np.zeros(len(pack(start))), None, start, 0
            for group, key, held in runs_of(batches, p.run_tokens):
                if group != now:
                    sums, now, model, n = sums + pack(model) * float(n), group, start, 0
                codes, sizes = decoded(held)
                kind, row = looked_up(codes, lay)
                model = fit_nce(model, share, contexts_of(lay.context[kind], sizes), kind, p, p.seed + i + (key & 0xFFFFFFFF), row, lay)
                every, n = every + len(codes), n + len(codes)
            if every:
                sums += pack(model) * float(n)
                for at in range(0, len(sums), p.chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([at // p.chunk]), pa.array([every]), pa.array([sums[at : at + p.chunk]], pa.list_(pa.float64()))], ["chunk", "n", "sums"])

        own = rows.where(F.pmod(F.xxhash64(F.lit(p.seed + 1), "key"), F.lit(p.rounds)) == i).select(group, "key", "codes")
        dealt = own.repartitionById(groups, "group").sortWithinPartitions("group", "key", "codes")
        tokens, mean = averaged(dealt.mapInArrow(run, "chunk long, n long, sums array<double>"), len(pack(model)), p, groups)
        if tokens:
            model = unpack(mean, model)
    return model


def looked_up(codes: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Class and row of each token by its head number (-1: *other*)."""
    if not len(lay.kind):
        return np.zeros(len(codes), np.int64), np.full(len(codes), -1)
    return np.where(codes >= 0, lay.kind[codes], OTHER), np.where(codes >= 0, lay.row[codes], -1)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:  # noqa: B008
    """Scores every row of ``docs`` with counts and a model of the rows for which ``held_out`` (a Column) is false.

    Returns ``id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``; scores are log10. Null and empty texts have the end as their only
    token. Repeated rows count and return as often as they occur; a null id is
    kept. An empty table gives an empty result.

    Counts of head words are broadcast (bounded by ``Params``). Words outside
    go by an equi-join on the word against the counts of the whole corpus.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), held_out.alias("held_out"))
    counts = durable(count_tokens(rows.where(~F.col("held_out")).select("id", "text")), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    head, head_n = head_of(counts, p)
    lay = layout_of(head, p)
    words = spark.sparkContext.broadcast((uuid.uuid4().hex, head))
    tokens = durable(coded(rows, words), "coded")
    model = spark.sparkContext.broadcast(train(tokens.where(~F.col("held_out")).select("key", "codes"), words, lay, head_n, total, p))
    own = lay.kind > OTHER  # words that the model knows
    other_n, other_v = total - int(head_n[own].sum()), distinct - int(own.sum())
    log10_n = np.log10(head_n + 1.0)

    def run(batches):
        for b in slices(batches, 4 * p.run_tokens, "codes"):
            codes, sizes = decoded(b.column(3).to_pylist())
            known = codes >= 0
            kind, row = looked_up(codes, lay)
            before = contexts_of(lay.context[kind], sizes)
            logs = (token_logs(model.value, before, kind, lay.classes) + within_logs(model.value, before, kind, row, lay)) / np.log(10)
            plain = np.where(known, log10_n[codes], 0.0) if len(log10_n) else np.zeros(len(codes))
            first = np.cumsum(sizes) - sizes
            per = lambda x: np.add.reduceat(x, first)
            columns = {
                "row": b.column(0), "id": b.column(1), "held_out": b.column(2),
                "n_tokens": pa.array(sizes), "n_head": pa.array(per(known.astype(np.int64))), "n_other": pa.array(per((kind == OTHER).astype(np.int64))),
                "plain": pa.array(per(plain)), "plain_other": pa.array(per(np.where(kind == OTHER, plain, 0.0))), "model": pa.array(per(logs)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind_of_id = rows.schema["id"].dataType.simpleString()
    scored = tokens.select("row", "id", "held_out", "codes").mapInArrow(
        run, f"row long, id {kind_of_id}, held_out boolean, n_tokens long, n_head long, n_other long, plain double, plain_other double, model double"
    )
    rare = tokens.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_log"))
    base = F.col("plain") + F.coalesce("rare_log", F.lit(0.0))
    others = F.col("plain_other") + F.coalesce("rare_log", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        (F.col("model") + others - F.col("n_other") * F.lit(float(np.log10(other_n + other_v + 1.0)))).alias("score"),
    )
