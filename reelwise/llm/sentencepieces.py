"""SentencePiece BPE encoding by backtracking, and decoding.

A token sequence is the BPE encoding of a text exactly when every two neighbours, merged again from
their characters, come back unchanged. The encoder walks a text with the longest vocabulary match at
each position (one Aho-Corasick pass), takes shorter prefixes while the match does not go with the
token before it, steps back when none does, and keeps a bit per position from which no encoding
continues.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelwise.llm.batches import slices

SPACE = "▁"
# Chunk patterns from fine to coarse. A pattern is used only if it leaves every piece whole: then no
# merge crosses a chunk border, because every merged symbol is a piece.
CHUNKS = (r" *(?:[^\W\d_]+|(?:(?! )[\W\d_])+)| +", " *[^ ]+| +")
CACHE = 350_000  # chunks per cache generation in one Python worker


@dataclass(frozen=True)
class PieceTable:
    """What encoding needs of a model file; small (bounded by the vocabulary) and sent with the task."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    normal: frozenset[int]
    dummy_prefix: bool
    unknown: int
    unknown_surface: str


def read_model(path: str) -> PieceTable:
    """Read a BPE model file with identity normalisation and byte fallback; other kinds are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    trainer, rules = model.trainer_spec, model.normalizer_spec
    if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
        raise ValueError("only BPE models with byte fallback and leading spaces are supported")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("only identity normalisation that keeps all blanks is supported")
    kind = model.SentencePiece
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    pieces = tuple(p.piece for p in model.pieces)
    index = {p: i for i, p in enumerate(pieces)}
    return PieceTable(
        pieces=pieces,
        scores=tuple(p.score for p in model.pieces),
        byte_ids=tuple(index[f"<0x{b:02X}>"] for b in range(256)),
        normal=frozenset(i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL),
        dummy_prefix=rules.add_dummy_prefix,
        unknown=trainer.unk_id,
        unknown_surface=trainer.unk_surface,
    )


@dataclass
class Codec:
    """Encoder and decoder for one piece table."""

    table: PieceTable
    cache: int = CACHE
    ids: dict[str, int] = field(init=False)
    matcher: ahocorasick.Automaton = field(init=False)

    def __post_init__(self):
        t = self.table
        self.ids = {t.pieces[i]: i for i in t.normal}
        self.matcher = ahocorasick.Automaton()
        self.score = {piece: t.scores[i] for piece, i in self.ids.items()}
        self.lengths = {i: len(piece) for piece, i in self.ids.items()}
        self.plain = {i: piece.replace(SPACE, " ") for piece, i in self.ids.items()}
        # The longest shorter piece that a piece starts with.
        self.shorter = {
            i: next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), None)
            for piece, i in self.ids.items()
        }
        self.together: dict[tuple, bool] = {}
        self.fresh: dict[str, tuple[bytes, str]] = {}
        self.stale: dict[str, tuple[bytes, str]] = {}
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        self.chunks = next(
            (p for p in map(re.compile, CHUNKS) if all(p.match(x).end() == len(x) for x in self.plain.values())),
            re.compile("(?s).+"),
        ).findall

    def remerge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: merge the best-scored neighbours, leftmost first, until no piece arises."""
        score, none = self.score.get, -float("inf")
        scores = [score(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while scores and (best := max(scores)) > none:
            k = scores.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = score(symbols[k - 1] + symbols[k], none)
            if k < len(scores):
                scores[k] = score(symbols[k] + symbols[k + 1], none)
        return symbols

    def compatible(self, left, right) -> bool:
        """Whether the two tokens, split into characters and merged again, come back as they are."""
        known = self.together.get((left, right))
        if known is None:
            if len(self.together) > 500_000:
                self.together.clear()
            whole = [x for x in (self.text(left), self.text(right)) if x]
            known = self.together[left, right] = self.remerge(list("".join(whole))) == whole
        return known

    def text(self, token) -> str:
        return token if isinstance(token, str) else "" if token is None else self.table.pieces[token]

    def encode_chunk(self, chunk: str) -> list:
        """Token ids; a character without a piece stands for itself."""
        whole = self.ids.get(chunk)
        if whole is not None and self.compatible(None, whole):
            return [whole]
        n = len(chunk)
        longest: list = list(chunk)
        for end, (length, i) in self.matcher.iter(chunk):
            longest[end - length + 1] = i
        lengths, together, shorter = self.lengths, self.together, self.shorter
        open_at = (1 << (n + 1)) - 1  # bit p: an encoding may still continue from position p
        out: list = []
        at = 0
        last = None
        token = longest[0]
        while at < n:
            end = at + lengths.get(token, 1)
            if open_at >> end & 1:
                fits = together.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    last, at = token, end
                    if end < n:
                        token = longest[end]
                    continue
            token = shorter.get(token)
            if token is None:
                open_at &= ~(1 << at)
                token = out.pop()
                at -= lengths.get(token, 1)
                last = out[-1] if out else None
        return out

    def encoded(self, chunk: str) -> tuple[bytes, str]:
        """Ids as int32 bytes and the decoded text of a chunk, remembered in two bounded generations."""
        found = self.stale.get(chunk)
        if found is None:
            out = self.encode_chunk(chunk.replace(" ", SPACE))
            try:
                text = "".join(map(self.plain.__getitem__, out))
                found = (array("i", out).tobytes(), chunk if text == chunk else text)  # one string instead of two equal ones
            except (TypeError, KeyError):  # a character became bytes
                out = [i for token in out for i in ([token] if isinstance(token, int) else map(self.table.byte_ids.__getitem__, token.encode()))]
                found = (array("i", out).tobytes(), self.surface(out))
        if len(self.fresh) >= self.cache:
            self.stale, self.fresh = self.fresh, {}
        self.fresh[chunk] = found
        return found

    def surface(self, ids: list[int]) -> str:
        parts, pending = [], bytearray()
        for i in ids:
            piece = self.table.pieces[i]
            if i in self.table.normal or len(piece) != 6 or self.table.byte_ids[int(piece[3:5], 16)] != i:
                if pending:
                    parts.append(broken(pending))
                    pending = bytearray()
                if i in self.table.normal:
                    parts.append(piece)
                elif i == self.table.unknown:
                    parts.append(self.table.unknown_surface)
            else:
                pending.append(int(piece[3:5], 16))
        if pending:
            parts.append(broken(pending))
        return "".join(parts).replace(SPACE, " ")

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (int32 bytes) of a text, and what they decode to."""
        if not text:
            return b"", ""
        # Blanks stand for the space mark, which the normalised text cannot tell from them.
        text = text.replace(SPACE, " ")
        chunks = self.chunks(" " + text if self.table.dummy_prefix else text)
        parts = list(map(self.fresh.get, chunks))
        k = -1
        for _ in range(parts.count(None)):
            k = parts.index(None, k + 1)
            parts[k] = self.fresh.get(chunks[k]) or self.encoded(chunks[k])
        ids, texts = zip(*parts)
        decoded = "".join(texts)
        return b"".join(ids), decoded[1:] if self.table.dummy_prefix and decoded[:1] == " " else decoded

    def decode(self, ids: list[int]) -> str:
        """Text of any id sequence; control pieces give nothing, the blank of the first piece goes."""
        text = self.surface(ids)
        return text[1:] if self.table.dummy_prefix and text[:1] == " " else text


def broken(raw: bytes) -> str:
    """UTF-8 with one replacement mark per byte that starts no character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[at : at + size]).decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODECS: dict[tuple[PieceTable, int], Codec] = {}


def codec(table: PieceTable, cache: int = CACHE) -> Codec:
    """One codec per Python worker, so that tasks share its caches."""
    if (table, cache) not in _CODECS:
        _CODECS.clear()
        _CODECS[table, cache] = Codec(table, cache)
    return _CODECS[table, cache]


def forget() -> None:
    """Drop this Python worker's codec and its caches."""
    _CODECS.clear()


def encode(
    df: DataFrame,
    table: PieceTable,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    cache: int = CACHE,
    keep: bool = True,
) -> DataFrame:
    """Add the token ids of `text` and the text they decode to.

    A Python worker remembers up to twice `cache` chunks (about 220 bytes each) until it ends, or with `keep` off until
    its task ends; a smaller cache costs time and changes no result.

    Null and empty texts have no ids and decode to "". Every row is kept as it is, repeated rows too;
    columns named `ids` or `decoded` are replaced. An empty table gives an empty table. A text of any
    length is encoded whole.
    """
    spark = df.sparkSession
    rest = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    schema = T.StructType(
        [*rest, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)]
    )
    sent = spark.sparkContext.broadcast(table)
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value, cache)
        try:
            for batch in batches:
                for rows, _, _ in slices(batch, text, 4 << 20):
                    done = [coder.encode(x) for x in rows.column(text).to_pylist()]
                    flat = np.frombuffer(b"".join(x[0] for x in done), np.int32)
                    ends = np.cumsum([0, *(len(x[0]) // 4 for x in done)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(rows.column(name) for name in names),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                            pa.array([x[1] for x in done], pa.string()),
                        ],
                        names=[*names, ids, decoded],
                    )
        finally:
            if not keep:
                forget()

    return df.select(*[_quoted(name) for name in names]).mapInArrow(run, schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
