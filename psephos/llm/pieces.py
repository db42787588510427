"""SentencePiece encoding and decoding: distinct segmentations by Gumbel top-k without replacement.

The lattice of a text has a node at each character and an arc for each piece of
the model. Texts are prepared as the model does (identity normaliser, dummy
prefix, spaces as pieces' own mark, bytes for unknown characters). No piece
holds a space but at its start, so a text falls into chunks whose lattices are
built once for each distinct chunk.

A segmentation has the product of its pieces' probabilities; a byte-pair model
has merge ranks only, so a piece of rank r gets the Zipfian log-probability
``-log(r + zipf)``, bytes that of a rank past the last. Forward sums make
every step of a path a normalised choice.

The search is A* on perturbed log-probabilities. The first sample is the path
that takes the largest perturbed child at each node. The queue then holds one
entry for each node on a found path: all siblings not taken there, with the
maximum of their Gumbel variates, truncated at the value of the path. Popping
the largest entry gives the next sample: its prefix, a sibling, and the best
completion; its own entries and what is left of the popped one go back to the
queue. The values come out in falling order, and the (k+1)-th is the threshold
of the inclusion probability ``1 - exp(-exp(log_prob - threshold))``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import lean, slices

MARK = "▁"  # stands for a space in pieces
#: Runs of spaces with the word after them; a line feed or a mark in the text stands alone.
CHUNK = re.compile(f" +[^ \n{MARK}]*|[\n{MARK}]|[^ \n{MARK}]+")
_MASK = (1 << 64) - 1
#: Characters of new chunks whose lattices are built at once, and arcs whose queue entries are made at once: a bound on memory, not on texts.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, int, float], ...]  # text, id, log-probability
    bytes_at: int  # id of byte 0
    byte_log: float
    size: int


def load(model_file: str, zipf: float = 10.0) -> Model:
    """Reads the vocabulary of a byte-pair SentencePiece model with byte fallback; nothing is trained. Another kind of model is refused."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(sp.get_score(i) > 0 or sp.get_score(i) % 1 for i in plain) or not sp.is_byte(sp.piece_to_id("<0x00>")):
        raise ValueError("a byte-pair model with byte fallback is wanted: its scores are merge ranks, which are whole")
    if sp.decode(sp.encode(odd := "\ufb01  x ")) != odd or not sp.encode("x", out_type=str)[0].startswith(MARK):
        raise ValueError("a model with the identity normaliser and a dummy prefix is wanted")
    pieces = tuple((sp.id_to_piece(i), i, -float(np.log(-sp.get_score(i) + zipf))) for i in plain)
    return Model(pieces, sp.piece_to_id("<0x00>"), -float(np.log(2.0 * sp.get_piece_size() + zipf)), sp.get_piece_size())


class Room:
    """An array with room for ``least`` entries that grows beyond them; adding copies what is added only, and room that was never used takes no memory."""

    def __init__(self, kind: type, least: int) -> None:
        self.held, self.size, self.least = np.empty(least, kind), 0, least

    def clear(self) -> None:
        """Room that is used again is not given back, which would leave gaps between what else was allocated; what it grew by is."""
        self.size = 0
        if len(self.held) > self.least:
            self.held = np.empty(self.least, self.held.dtype)

    def add(self, new: np.ndarray) -> np.ndarray:
        """All that was added so far, with ``new`` at its end."""
        size = self.size + len(new)
        if size > len(self.held):
            held = np.empty(max(size, len(self.held) * 3 // 2), self.held.dtype)
            held[: self.size] = self.held[: self.size]
            self.held = held
        self.held[self.size : size] = new
        self.size = size
        return self.held[:size]


class Lattices:
    """Arcs of all chunks seen so far, in arrays; starts anew beyond ``max_arcs``. New chunks are built in blocks, which bounds what a build holds besides."""

    def __init__(self, model: Model, max_arcs: int = 1_500_000) -> None:
        self.model, self.max_arcs = model, max_arcs
        # a trie of the pieces: transitions by (node, character), the piece that ends at each node or -1
        node, step, ends = {"": 0}, {}, [-1]
        for n, (text, _, _) in enumerate(model.pieces):
            for i in range(1, len(text) + 1):
                if text[:i] not in node:
                    node[text[:i]] = len(node)
                    ends.append(-1)
                    step[node[text[: i - 1]] << 21 | ord(text[i - 1])] = node[text[:i]]
            ends[node[text]] = n
        self.keys = np.array(sorted(step), np.int64)
        self.child = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int32)
        self.at = np.full(1 << 20, -1, np.int32)  # place of a transition by its hash; one of those that share a hash
        self.at[self.slot(self.keys)] = np.arange(len(self.keys))
        self.id, self.lp = np.array([i for _, i, _ in model.pieces], np.int32), np.array([w for _, _, w in model.pieces])
        least = max_arcs + (max_arcs >> 2)  # the last slice goes beyond
        self.room = {n: Room(t, least) for n, t in (("start", np.int64), ("first", np.int64), ("cum", np.float32), ("log", float), ("rest", float), ("next", np.int32), ("piece", np.int32))}
        self.clear()

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def matches(self, code: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the starts and pieces of all matches: every place walks down the trie at once."""
        out, at, node, n = [], np.arange(len(code)), np.zeros(len(code), np.int64), 0
        while len(at):
            inside = at + n < len(code)
            at, node = at[inside], node[inside]
            key = node << 21 | code[at + n]
            to = self.at[self.slot(key)]
            some = np.flatnonzero(to >= 0)
            key, to = key[some], to[some]
            other = np.flatnonzero(self.keys[to] != key)  # another one, or none
            to[other] = np.minimum(np.searchsorted(self.keys, key[other]), len(self.keys) - 1)
            ok = self.keys[to] == key
            at, node = at[some[ok]], self.child[to[ok]]
            n += 1
            end = self.ends[node]
            out.append((at[end >= 0], end[end >= 0]))
        return out

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.unknown: dict[str, int] = {}  # characters outside the vocabulary, numbered after the pieces
        self.unknown_bytes: list[bytes] = []
        for r in self.room.values():
            r.clear()
        self.start = np.zeros(0, np.int64)  # of each chunk, its last node, where paths start
        self.first = self.room["first"].add(np.zeros(1, np.int64))  # of each node, its first arc; one more at the end
        self.cum = np.zeros(0, np.float32)  # of each arc: cumulative probability in its node
        self.log, self.rest = np.zeros(0), np.zeros(0)  # log-probability of each arc, and the probability of its siblings together
        self.next, self.piece = np.zeros(0, np.int32), np.zeros(0, np.int32)  # next node (-1: start of the chunk)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """Number of each chunk; lattices of new ones are built."""
        if len(self.cum) > self.max_arcs:
            self.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            start, size = 0, 0
            for i, c in enumerate(new):
                if i > start and size + len(c) > BLOCK:
                    self.build(new[start:i])
                    start, size = i, 0
                size += len(c)
            self.build(new[start:])
        return np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))

    def fallback(self, c: str) -> tuple[int, float]:
        raw = c.encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return self.model.bytes_at + raw[0], self.model.byte_log
        if c not in self.unknown:
            self.unknown[c] = self.model.size + len(self.unknown)
            self.unknown_bytes.append(raw)
        return self.unknown[c], self.model.byte_log * len(raw)

    def build(self, chunks: list[str]) -> None:
        """Adds the lattices of new chunks. Paths run from the end of a chunk to its start, as arcs are kept in the order of their ends."""
        inside = [c.replace(" ", MARK) if c != MARK else "\n" for c in chunks]
        joined = "\n".join(inside) + "\n"
        sizes = np.fromiter(map(len, inside), np.int64, len(inside))
        begin = np.cumsum(sizes + 1) - sizes - 1
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code[begin + sizes] = 0x1FFFFF  # no character
        if MARK in chunks:  # a mark in the text is no space
            code[begin[chunks.index(MARK)]] = 0x1FFFFE
        found = self.matches(code)
        lone = code != 0x1FFFFF
        lone[found[0][0]] = False
        odd = np.flatnonzero(lone)  # characters without a piece
        given = [self.fallback(MARK if c == 0x1FFFFE else chr(c)) for c in code[odd].tolist()]
        # the longest piece of an end first
        start = np.concatenate([*[x for x, _ in found[::-1]], odd]).astype(np.int32)
        last = np.concatenate([*[x + n for n, (x, _) in reversed(list(enumerate(found)))], odd]).astype(np.int32)
        which = np.concatenate([y for _, y in found[::-1]])
        piece = np.concatenate([self.id[which], np.array([g[0] for g in given], np.int32)])
        weight = np.concatenate([self.lp[which], np.array([g[1] for g in given], float)])
        order = np.argsort(last, kind="stable")
        start, last, piece, weight = start[order], last[order], piece[order], weight[order]
        # nodes are the characters, each as the end of what comes before
        nodes = int(sizes.sum())
        inner = np.ones(len(joined), bool)
        inner[begin + sizes] = False
        node = (np.cumsum(inner) - 1).astype(np.int32)
        place = (np.arange(len(joined)) - np.repeat(begin, sizes + 1)).astype(np.int32)
        here = node[last]
        ahead = np.where(place[start] == 0, np.int32(-1), node[start] - 1)
        first = np.concatenate([[0], np.cumsum(np.bincount(here, minlength=nodes))])
        # forward sums, one place after the other for all chunks at once; the last entry (-1) is the start of a chunk
        alpha = np.zeros(nodes + 1)
        depth = place[last]
        order = np.argsort(depth.astype(np.uint16) if len(joined) < 1 << 16 or sizes.max(initial=0) < 1 << 16 else depth, kind="stable")
        of, w, frm = here[order], weight[order], ahead[order]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        cuts = np.flatnonzero(np.diff(depth[order][heads], prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], len(heads)], strict=True):
            x, y = heads[lo], heads[hi] if hi < len(heads) else len(of)
            v, seg = np.exp(w[x:y] + alpha[frm[x:y]] - (base := alpha[frm[x:y]].max())), heads[lo:hi] - x
            sums = np.add.reduceat(v, seg)
            if sums.min() < 1e-200:  # far apart: each node by its own maximum
                v = w[x:y] + alpha[frm[x:y]]
                top = np.maximum.reduceat(v, seg)
                alpha[of[heads[lo:hi]]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, np.diff(np.append(seg, y - x)))), seg))
            else:
                alpha[of[heads[lo:hi]]] = base + np.log(sums)
        log = np.minimum(weight + alpha[ahead] - alpha[here], 0.0)
        prob = np.exp(log)
        total = np.cumsum(prob)
        cum = (total - np.concatenate([[0.0], total])[first[:-1]][here]).astype(np.float32)
        rest = np.zeros(len(log))
        if nodes:
            cum[first[1:] - 1] = 2.0  # the last arc of a node takes the rest
            # what the siblings have; those of a likely arc are summed, as 1 - p would lose their digits
            likely = log > -0.5
            rest = np.where(likely, np.add.reduceat(np.where(likely, 0.0, prob), first[:-1])[here], 1 - prob)
        arcs_before, nodes_before = len(self.cum), len(self.first) - 1
        add = lambda name, new: self.room[name].add(new)
        self.start = add("start", node[begin + sizes - 1] + nodes_before)
        self.first = add("first", first[1:] + arcs_before)
        self.cum, self.log, self.rest = add("cum", cum), add("log", log), add("rest", rest)
        self.next = add("next", np.where(ahead < 0, np.int32(-1), ahead + np.int32(nodes_before)))
        self.piece = add("piece", piece)

    def ids(self, arcs: np.ndarray) -> np.ndarray:
        """Piece ids of a path in the order of the text; an unknown character becomes the ids of its bytes."""
        pieces = self.piece[arcs[::-1]]
        size = self.model.size
        if not len(pieces) or pieces.max() < size:
            return pieces
        out: list[int] = []
        for p in pieces.tolist():
            out.extend((p,) if p < size else (self.model.bytes_at + x for x in self.unknown_bytes[p - size]))
        return np.array(out, np.int32)


class Bytes:
    """The bytes of each piece, in one array; an id outside the vocabulary stands for U+FFFD, one without text (control) for nothing."""

    def __init__(self, model: Model) -> None:
        own = [b""] * model.size + ["\ufffd".encode()]
        for text, i, _ in model.pieces:
            own[i] = text.replace(MARK, " ").encode()
        for x in range(256):
            own[model.bytes_at + x] = bytes([x])
        self.size = model.size
        self.lengths = np.fromiter(map(len, own), np.int64, len(own))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(own), np.uint8)

    def texts(self, ids: list[np.ndarray], block: int = 1 << 20) -> list[bytes]:
        """The text of each list of ids, without the dummy prefix; a block of ids at a time."""
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        every = np.where((every >= 0) & (every < self.size), every, self.size)
        lengths = self.lengths[every]
        made = []
        for at in range(0, len(every), block):
            n = lengths[at : at + block]
            ends = np.cumsum(n)
            made.append(self.flat[np.repeat(self.starts[every[at : at + block]] - ends + n, n) + np.arange(ends[-1])].tobytes())
        whole = b"".join(made)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, ids)])].tolist()
        return [whole[a + 1 : b] for a, b in zip(ends, ends[1:], strict=False)]


def uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    """Variates in (0, 1) that each seed decides."""
    z = seed + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def walk(lat: Lattices, node: np.ndarray, seed: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """From each node (-1: none) to the start of its chunk, each step in proportion: arcs in order, and the number of them for each start."""
    live, steps, step = np.flatnonzero(node >= 0), [], 0
    at = node[live]
    count = np.zeros(len(node), np.int64)
    while len(live):
        u = uniform(seed[live], salt * 1_000_003 + step)
        arc = lat.first[at]
        todo = np.flatnonzero(u >= lat.cum[arc])
        while len(todo):
            arc[todo] += 1
            todo = todo[u[todo] >= lat.cum[arc[todo]]]
        steps.append((live, arc))
        count[live] += 1
        at = lat.next[arc]
        going = at >= 0
        live, at = live[going], at[going]
        step += 1
    offset = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for i, (own, arc) in enumerate(steps):
        out[offset[own] + i] = arc
    return out, count


def below(top: np.ndarray, before: np.ndarray, mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates at ``before + log(mass)`` given that they are under ``top``, as x of ``top - log1p(x)``: the least x is the largest variate, infinity stands where there is no mass."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(u) * np.exp(top - before) / mass


@dataclass
class Entries:
    """Queue entries of a path from position ``since`` on, all truncated at the path's value ``top``."""

    x: np.ndarray
    top: float
    before: np.ndarray  # log-probability of the prefix before each
    since: int
    taken: dict[int, list[int]]  # of popped entries: the arcs gone from there

    def best(self) -> tuple[float, int]:
        """The largest value (minus infinity: none) and its position."""
        if not len(self.x):
            return -np.inf, 0
        i = int(self.x.argmin())
        return float(self.top - np.log1p(self.x[i])), self.since + i


@dataclass
class Found:
    """One sampled segmentation of a text, as arcs from its end to its start with the numbers of the chunks they stand in."""

    arcs: np.ndarray
    chunk: np.ndarray
    log_prob: float
    value: float


def top_k(lat: Lattices, texts: list[str], seeds: list[int], k: int) -> Iterator[tuple[list[Found], float]]:
    """The k segmentations of each text with the largest perturbed values (fewer if there are no more), and the value after them."""
    chunks = [CHUNK.findall(" " + t)[::-1] if t else [] for t in texts]  # from the end of the text to its start
    sizes = [len(c) for c in chunks]
    numbers = lat.numbers([c for own in chunks for c in own])
    seed_of = np.array(seeds, np.uint64)
    row = np.repeat(seed_of, sizes)
    place = np.concatenate([np.arange(n) for n in sizes]).astype(np.uint64) if sizes else np.zeros(0, np.uint64)
    seed = row + place * np.uint64(0xD1B54A32D192ED03)
    arcs, count = walk(lat, lat.start[numbers], seed, 1)
    chunk_at = np.repeat(np.arange(len(numbers)), count)
    text_ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    arc_ends = np.concatenate([[0], np.cumsum(count)])[text_ends]
    first = -np.log(-np.log(uniform(seed_of, 7)))
    paths = [(arcs[x:y], chunk_at[x:y] - text_ends[i]) for i, (x, y) in enumerate(zip(arc_ends[:-1].tolist(), arc_ends[1:].tolist(), strict=True))]
    begun = entries(lat, paths, [0] * len(texts), first, seed_of, 1)
    found: list[list[Found]] = [[f] for f, _ in begun]
    queues: list[list[Entries]] = [[e] for _, e in begun]  # of each text, for each path
    for turn in range(2, k + 2):
        popped: list[tuple[int, int, int, float]] = []  # text, path, position, value
        for i, queue in enumerate(queues):
            if len(found[i]) != turn - 1:
                continue
            best, path, at = max((v, -n, i) for n, (v, i) in enumerate(e.best() for e in queue))
            if best == -np.inf:
                continue
            if turn == k + 1:
                found[i].append(Found(np.zeros(0, np.int64), np.zeros(0, np.int64), -np.inf, best))
                continue
            popped.append((i, -path, at, best))
        if turn == k + 1 or not popped:
            break
        taken = take_siblings(lat, [(queues[i][path], found[i][path].arcs, at, value) for i, path, at, value in popped], seed_of[[x[0] for x in popped]], turn)
        starts, sow = [], []
        for (i, path, at, _), arc in zip(popped, taken, strict=True):
            lo, hi = text_ends[i] + int(found[i][path].chunk[at]), text_ends[i + 1]
            nodes = lat.start[numbers[lo:hi]]
            nodes[0] = lat.next[arc]
            starts.append(nodes)
            sow.append(seed[lo:hi])
        more, steps = walk(lat, np.concatenate(starts), np.concatenate(sow), turn)
        ends = np.concatenate([[0], np.cumsum(steps)])
        a, paths = 0, []
        for (i, path, at, _), arc, nodes in zip(popped, taken, starts, strict=True):
            old, n = found[i][path], len(nodes)
            tail_chunk = np.repeat(np.arange(n), steps[a : a + n]) + old.chunk[at]
            paths.append((np.concatenate([old.arcs[:at], [arc], more[ends[a] : ends[a + n]]]), np.concatenate([old.chunk[: at + 1], tail_chunk])))
            a += n
        values = np.array([x[3] for x in popped])
        made = entries(lat, paths, [x[2] + 1 for x in popped], values, seed_of[[x[0] for x in popped]], turn)
        for (i, *_), (f, e) in zip(popped, made, strict=True):
            found[i].append(f)
            queues[i].append(e)
    for own in found:
        last = own.pop() if len(own) == k + 1 else None
        yield own, last.value if last else -np.inf


def entries(lat: Lattices, paths: list[tuple[np.ndarray, np.ndarray]], since: list[int], values: np.ndarray, seeds: np.ndarray, turn: int) -> list[tuple[Found, Entries]]:
    """The new path (arcs, chunks) of each text, and its queue entries from ``since`` on, where it leaves an old one; all texts of a block at once."""
    out: list[tuple[Found, Entries]] = []
    ends = np.cumsum([0, *(len(x) for x, _ in paths)])
    a = 0
    while a < len(paths):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK, "right")) - 1)
        out += block_entries(lat, paths[a:b], since[a:b], values[a:b], seeds[a:b], turn)
        a = b
    return out


def block_entries(lat: Lattices, paths: list[tuple[np.ndarray, np.ndarray]], since: list[int], values: np.ndarray, seeds: np.ndarray, turn: int) -> list[tuple[Found, Entries]]:
    sizes = np.array([len(x) for x, _ in paths], np.int64)
    arcs = np.concatenate([x for x, _ in paths]) if paths else np.zeros(0, np.int64)
    log, total = lat.log[arcs], np.empty(len(arcs))
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    sums = []
    for a, b in zip(ends, ends[1:], strict=False):
        np.cumsum(log[a:b], out=total[a:b])
        sums.append(float(log[a:b].sum()))
    which = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(arcs)) - np.repeat(np.array(ends[:-1], np.int64), sizes)
    own = np.flatnonzero(at >= np.array(since, np.int64)[which])
    which, at, before = which[own], at[own], total[own] - log[own]
    u = uniform(seeds[which] + at.astype(np.uint64) * np.uint64(0xA0761D6478BD642F), 100 + turn)
    x = below(values[which], before, lat.rest[arcs[own]], u)
    ends = np.searchsorted(which, np.arange(len(sizes) + 1)).tolist()
    out = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        value = float(values[i])
        out.append((Found(*paths[i], sums[i], value), Entries(x[a:b], value, before[a:b], since[i], {})))
    return out


def take_siblings(lat: Lattices, popped: list[tuple[Entries, np.ndarray, int, float]], seeds: np.ndarray, turn: int) -> list[int]:
    """For each popped entry (entries, path, position, value) draws a sibling of the path's arc there, in proportion, and puts what is left of it back."""
    own = np.array([arcs[at] for _, arcs, at, _ in popped])
    node = np.searchsorted(lat.first, own, "right") - 1
    lo, hi = lat.first[node].tolist(), lat.first[node + 1].tolist()
    place = np.array([at for _, _, at, _ in popped], np.uint64)
    u, again = uniform(seeds + place, 5000 + turn).tolist(), uniform(seeds + place + np.uint64(1), 5000 + turn)
    taken, left = [], []
    for i, (entry, _, at, _) in enumerate(popped):
        gone = entry.taken.setdefault(at, [int(own[i])])
        others = [x for x in range(lo[i], hi[i]) if x not in gone]
        p = np.exp(lat.log[others]).tolist()
        goal, n = u[i] * sum(p), 0
        while n < len(p) - 1 and goal >= p[n]:
            goal -= p[n]
            n += 1
        gone.append(others[n])
        taken.append(others[n])
        left.append(sum(p[:n]) + sum(p[n + 1 :]))
    before = np.array([e.before[at - e.since] for e, _, at, _ in popped])
    value, top = np.array([v for *_, v in popped]), np.array([e.top for e, *_ in popped])
    with np.errstate(over="ignore"):  # under the popped value now, in terms of the path's
        x = np.expm1(top - value + np.log1p(below(value, before, np.array(left), again)))
    for (entry, _, at, _), new in zip(popped, x.tolist(), strict=True):
        entry.x[at - entry.since] = new
    return taken


SAMPLE = "sample int, log_prob double, perturbed double, inclusion double"


def sampled(docs: DataFrame, model_file: str, k: int, id_col: str, text_col: str, seed: int, slice_bytes: int, what: str, digest: bool) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def run(batches):
        lat, table = Lattices(model.value), Bytes(model.value)
        for b in slices(batches, slice_bytes):
            raw = b.column(2).to_pylist()
            seeds = [xxhash.xxh64_intdigest(x, seed) for x in b.column(1).to_pylist()]
            rows: list[tuple] = []
            ids: list[np.ndarray] = []
            for i, (own, after) in enumerate(top_k(lat, [t.decode("utf-8", "replace") for t in raw], seeds, k)):
                for n, f in enumerate(own):
                    inclusion = 1.0 if after == -np.inf else float(-np.expm1(-np.exp(min(50.0, f.log_prob - after))))
                    rows.append((i, n + 1, f.log_prob, f.value, inclusion))
                    ids.append(lat.ids(f.arcs))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            made = [pa.array(c, t) for c, t in zip(columns[1:], [pa.int32(), pa.float64(), pa.float64(), pa.float64()], strict=True)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if digest:
                back = [t == raw[i] for i, t in zip(columns[0], table.texts(ids), strict=True)]
                hashes = [hashlib.sha256(x.astype("<i4", copy=False).tobytes()).hexdigest() for x in ids]
                made += [pa.array(sizes), pa.array(hashes, pa.string()), pa.array(back, pa.bool_())]
            else:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32())))
            names = ["sample", "log_prob", "perturbed", "inclusion", *(["n_pieces", "ids_sha256", "round_trip"] if digest else ["ids"])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *made], ["id", *names])
            made = None
            pa.default_memory_pool().release_unused()

    text = F.coalesce(docs[text_col].cast("binary"), F.lit(b""))
    key = F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), key.alias("key"), text.alias("text"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, {SAMPLE}, {what}")


def sample_segmentations(
    docs: DataFrame, model_file: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, slice_bytes: int = 1 << 19
) -> DataFrame:
    """``id, sample, log_prob, perturbed, inclusion, ids``: k distinct segmentations of each text, the largest perturbed first.

    The row's id seeds the draw, so repeated rows give equal samples. A text
    with fewer segmentations gives all of them, with inclusion 1. A null or
    empty text has one, without pieces. A null id counts as the empty one.
    """
    return sampled(docs, model_file, k, id_col, text_col, seed, slice_bytes, "ids array<int>", False)


def segmentation_digests(
    docs: DataFrame, model_file: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, slice_bytes: int = 1 << 19
) -> DataFrame:
    """As ``sample_segmentations``, with ``n_pieces``, ``ids_sha256`` and ``round_trip`` (the ids decode to the text) in place of the ids."""
    return sampled(docs, model_file, k, id_col, text_col, seed, slice_bytes, "n_pieces long, ids_sha256 string, round_trip boolean", True)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null ids give a null. A column of that name is replaced.

    An id outside the vocabulary, or a null among the ids, becomes U+FFFD; so do bytes that are no UTF-8.
    """
    model = encoded.sparkSession.sparkContext.broadcast(load(model_file))

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Bytes(model.value)
        for s in batches:
            known = s.notna()
            ids = [np.array([-1 if i is None or i != i else i for i in x], np.int64) for x in s[known]]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known] = [t.decode("utf-8", "replace") for t in table.texts(ids)]
            yield out

    return encoded.withColumn("decoded", F.pandas_udf(texts, "string")(F.col(ids_col)))
