"""Cost-balanced packing of tokenised documents into sequences of equal length."""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm._shared import id_and_text, slices

#: The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of Latin-1, and the ASCII characters that end a word of them: all but letters and the apostrophe.
LETTER, AFTER = "A-Za-zÀ-ÖØ-öø-ÿ", r"\x00-\x26\x28-\x40\x5b-\x60\x7b-\x7f"
#: A word with the space before it, if any; a line feed before a word; else a run of white space and what follows it. A chunk starts where the tokenizer's own pieces part too.
CHUNK = re.compile(f" ?[{LETTER}]+(?=[{AFTER}])|\n(?=[{LETTER}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Fixed value: how byte-level vocabularies of this kind part a text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a task remembers in each of two generations, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Characters of a text that are taken apart at once.
WINDOW = 1 << 18


@functools.cache
def loaded(path: str):
    """The byte-level BPE of a file of the tokenizers library, once a process: its merges by rank, applied by tiktoken, whose ids are the same and take a fourth of the time. Other kinds are refused."""
    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
    merged = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", []))
    if not plain or any(model["vocab"][m] != 256 + k for k, m in enumerate(merged)):
        raise ValueError(f"{path} is no plain byte-level BPE whose ids follow its merges")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow 255
    sign = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(sign[c] for c in token): k for token, k in model["vocab"].items() if k < 256 + len(model["merges"])}
    return tiktoken.Encoding(Path(path).stem, pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit numbers; a dictionary of the ids of chunks met of late.

    Equal to the tokenizer's ids for the whole text: no piece of a byte-level
    vocabulary of this kind goes on from other characters to white space, or
    from a word to punctuation but the apostrophe. So chunks are encoded one by
    one, and frequent ones once. Special strings in a text are ordinary text.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.encode = loaded(path).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            ids = self.encode(chunk)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encoded(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            chunks = CHUNK.findall(text, at, at + WINDOW)
            if at + WINDOW < len(text) and len(chunks) > 1:
                chunks.pop()  # it may go on
            elif at + WINDOW < len(text):
                chunks = [CHUNK.match(text, at)[0]]  # longer than a window
            at += sum(map(len, chunks))
            out.append(b"".join(map(self.__getitem__, chunks)))
        return b"".join(out)


def cost(n: np.ndarray | int, length: int):
    """Estimated cost of a document's piece of ``n`` tokens: a linear part for all layers, and a quadratic one for attention, which equals it at full length."""
    return n + n * n / length


def capacities(total: int, length: int) -> list[int]:
    """Lengths of the sequences that ``total`` tokens fill without padding: full ones, and falling powers of two for the rest, which need none."""
    return [length] * (total // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]


def dealt(lengths: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """``document, start, length, sequence, offset`` of the pieces of documents of ``lengths`` tokens, in sequences that they fill.

    Full lengths of a document are sequences of their own. What is left of the
    documents is taken in falling order of cost, ties by place; each goes to
    the sequence of least cost so far that has room for it, or in parts to those of least cost with any room where none has
    enough. All sequences together hold just all tokens, so each is full in the end.
    """
    out, n = [], 0
    left = []
    for k, size in enumerate(lengths):
        for start in range(0, size - length + 1, length):
            out.append((k, start, length, n, 0))
            n += 1
        if size % length:
            left.append((size % length, k))
    room = np.array(capacities(sum(x for x, _ in left), length), np.int64)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    for size, k in sorted(left, key=lambda x: (-x[0], x[1])):
        start = lengths[k] - size
        while size:
            fits = room >= size
            s = int(np.where(fits if fits.any() else room > 0, spent, np.inf).argmin())
            part = min(size, int(room[s]))
            out.append((k, start, part, n + s, int(used[s])))
            room[s], used[s], spent[s] = room[s] - part, used[s] + part, spent[s] + cost(part, length)
            start, size = start + part, size - part
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, length: int = 2048, block_tokens: int = 1 << 20) -> DataFrame:
    """``id, start, ids, doc_tokens, sequence, offset``: the documents' tokens, each closed by ``end``, cut and packed into sequences of ``length``, a power of two.

    One narrow pass and no shuffle: a task encodes its rows and packs them block by block (``dealt``) of
    about ``block_tokens``, so memory is bounded by a block and the longest
    text. Sequences of a block are full but for some whose length is a falling
    power of two, eleven at most. ``sequence`` has the task's number in its upper bits;
    the numbers are unique but not gapless. ``ids`` are little-endian unsigned
    32-bit numbers. Rows, not ids, are packed: repeated rows are packed each, null
    texts count as empty and have the end only. An empty table gives an empty result.
    The packing depends on which rows a task reads, never on other tasks, so a rerun task gives the same.
    """
    if length & (length - 1):
        raise ValueError("the length must be a power of two")
    tail = np.array([end], "<u4").tobytes()
    rows = id_and_text(docs, id_col, text_col).select("id", F.col("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "start", "ids", "doc_tokens", "sequence", "offset"]

    def packed(ids: list, tokens: list[bytes], base: int, kind: pa.DataType) -> tuple[list[pa.RecordBatch], int]:
        pieces = dealt([len(t) // 4 for t in tokens], length)
        out = []
        for at in range(0, len(pieces), 2048):
            some = pieces[at : at + 2048]
            columns = [
                pa.array([ids[k] for k, *_ in some], kind), pa.array([p[1] for p in some], pa.int64()),
                pa.array([tokens[k][4 * start : 4 * (start + n)] for k, start, n, _, _ in some], pa.binary()),
                pa.array([len(tokens[p[0]]) // 4 for p in some], pa.int64()), pa.array([base + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()),
            ]
            out.append(pa.RecordBatch.from_arrays(columns, names))
        return out, base + 1 + max((p[3] for p in pieces), default=-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, base = Encoder(tokenizer), TaskContext.get().partitionId() << 33
        ids, tokens, size, arrow_kind = [], [], 0, None
        for b in slices(batches, 1 << 20):
            arrow_kind = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                tokens.append(encoder.encoded(text.decode("utf-8", "replace")) + tail)
                size += len(tokens[-1]) // 4
                if size >= block_tokens:
                    out, base = packed(ids, tokens, base, arrow_kind)
                    yield from out
                    ids, tokens, size = [], [], 0
        if ids:
            yield from packed(ids, tokens, base, arrow_kind)[0]

    return rows.mapInArrow(run, f"id {kind}, start long, ids binary, doc_tokens long, sequence long, offset long")


def sequences(pieces: DataFrame, length: int = 2048, pad: int = 0) -> DataFrame:
    """``sequence, ids, n_tokens, pieces``: the tokens of each sequence in order, padded to ``length`` unless their number is a power of two, and what lies where.

    A sequence has ``length`` pieces at most, so none is gathered beyond that.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "id", "start", "ids")))
    rows = pieces.groupBy("sequence").agg(parts.alias("parts"))
    ids = F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")
    n = F.length("hex") / 8
    short = F.log2("n") != F.floor(F.log2("n"))
    blank = F.lit(np.array([pad], "<u4").tobytes().hex())
    padded = F.when(short, F.concat("hex", F.repeat(blank, F.lit(length) - F.col("n")))).otherwise(F.col("hex"))
    rows = rows.withColumn("hex", ids).withColumn("n", n.cast("int"))
    what = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["id"].alias("id"), p["start"].alias("start")))
    return rows.select("sequence", F.unhex(padded).alias("ids"), F.col("n").alias("n_tokens"), what.alias("pieces"))
