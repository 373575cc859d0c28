"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton over the vocabulary finds, in one pass over a piece of
text, the tokens that start at each position. The encoder takes the longest and
steps back to a shorter one where two neighbours are incompatible. Two tokens
are compatible when the merges leave their concatenation as just these two; a
sequence whose neighbours are all compatible is the one the merges give, so a
position that failed once never has to be tried again and the work is linear.
The compatibility table is filled as pairs appear, and emptied when it is large.

The vocabulary file is read by the driver and broadcast; its size is fixed by
the tokenizer, not by the data.

Cases: a null text is the empty text and has no tokens; special tokens in a text
become their ids, as the tokenizers library does it; texts of any length are
encoded whole; rows repeated in full are encoded each; a null id stays null; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenization pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to so many characters are remembered, and so many of them.
CACHED_CHARS, CACHED_PIECES = 48, 400_000
#: Pairs that the compatibility table holds before it is filled anew.
CACHED_PAIRS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, spec_json: str) -> None:
        spec = json.loads(spec_json)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: name for name, i in self.ids.items()}
        self.ranks = {(a, b): r for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        self.made = {a + b: (a, b) for a, b in self.ranks}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if name not in self.special:
                self.automaton.add_word(name, (i, len(name)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        back = {c: b for b, c in enumerate(self.alphabet)}
        blob, self.starts = bytearray(), np.zeros(max([*self.names, *self.special.values()]) + 2, dtype=np.int64)
        spelled = {i: bytes(back[c] for c in name) for i, name in self.names.items()} | {i: name.encode() for name, i in self.special.items()}
        for i in range(len(self.starts) - 1):
            blob += spelled.get(i, b"")
            self.starts[i + 1] = len(blob)
        self.blob = np.frombuffer(bytes(blob), dtype=np.uint8)

    def edge(self, name: str, side: int) -> list[tuple[str, int, int]]:
        """The symbols that stand at the left (0) or right (1) end of a token while it is merged, the token first: with the ranks of the merges that make each and that use it up."""
        out, used = [], len(self.ranks)
        while True:
            parts = self.made.get(name)
            rank = self.ranks[parts] if parts else -1
            out.append((name, rank, used))
            if not parts:
                return out
            name, used = parts[side], rank

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges keep tokens a and b apart: no merge across the border comes before both symbols there are used up. Of merges of one rank, the left one is first."""
        known = self.fits.get((a, b))
        if known is None:
            known = True
            for x, x_made, x_used in self.edge(self.names[a], 1):
                for y, y_made, y_used in self.edge(self.names[b], 0):
                    rank = self.ranks.get((x, y))
                    if rank is not None and (when := max(rank, x_made, y_made)) < x_used and when <= y_used:
                        known = False
            if len(self.fits) >= CACHED_PAIRS:
                self.fits.clear()
            self.fits[a, b] = known
        return known

    def backtrack(self, piece: str) -> tuple[int, ...]:
        spelled = "".join(map(self.alphabet.__getitem__, piece.encode()))
        n = len(spelled)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(spelled):
            found[end - token[1] + 1].append(token)
        taken: list[tuple[int, int, int]] = []
        failed: set[int] = set()
        at, choice = 0, len(found[0]) - 1
        while at < n:
            options = found[at]
            while choice >= 0 and (at + options[choice][1] in failed or (taken and not self.compatible(taken[-1][0], options[choice][0]))):
                choice -= 1
            if choice >= 0:
                token, length = options[choice]
                taken.append((token, length, choice))
                at += length
                choice = len(found[at]) - 1
            else:
                failed.add(at)
                _, length, choice = taken.pop()
                at -= length
                choice -= 1
        return tuple(t[0] for t in taken)

    def piece(self, piece: str) -> tuple[int, ...]:
        known = self.cache.get(piece)
        if known is None:
            known = self.backtrack(piece)
            if len(piece) <= CACHED_CHARS:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def plain(self, text: str) -> Iterator[tuple[int, ...]]:
        return map(self.piece, self.pieces.findall(text))

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            yield from self.plain(text[at : m.start()])
            yield (self.special[m[0]],)
            at = m.end()
        yield from self.plain(text[at:] if at else text)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(itertools.chain.from_iterable(self.parts(text)), dtype=np.int32)

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text)))

    def decode(self, ids: np.ndarray) -> str:
        """Gather each token's bytes by its offsets."""
        ids = np.asarray(ids, dtype=np.int64)
        first, size = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder_for(spec_json: str) -> Encoder:
    """One encoder for each vocabulary in a worker process, kept from task to task."""
    return Encoder(spec_json)


def spec_of(df: DataFrame, tokenizer: str | None):
    """Broadcast of the tokenizer file's text."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def tokens_of(spec, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            ids = [encoder.encode(t) for t in pc.fill_null(batch.column(1), "").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            columns = [batch.column(0), lists]
            if decoded:
                columns.append(pa.array([encoder.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the text that decode() makes of the ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tokens_of(spec_of(docs, tokenizer), decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of rows with token ids; null ids are no tokens."""
    spec = spec_of(tokens, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in itertools.chain.from_iterable(map(slices, batches)):
            texts = [encoder.decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
