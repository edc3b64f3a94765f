"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A token sequence is the BPE encoding of its text exactly when every token encodes to itself and so does every pair of
neighbours. The encoding of a prefix is therefore the encoding of a shorter prefix plus one token, which is unique and
can be found from the left.

How much of it text still to come can change follows from the merge list (``Merges.lookahead``). Let the merges run in
their order on a text and on the same text continued. Both agree up to a boundary, at first the end of the shorter one.
The boundary moves left only when a merge (u, v) takes the last agreed token u together with a v behind the boundary,
which one of the two texts has and the other not; it then moves by the length of u, and behind it stands u or uv, which
can only grow to the right. Moves come in the order of the merges, so the longest chain of moves is a longest path over
the merge list. Tokens that end before it are stable and are emitted; memory doesn't depend on the length of the text.

Every text goes through the transducer, in blocks, and so does every run that the published pattern cuts from it. Ids of
finished runs are remembered, as the same words come again and again.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from landweave.session import ship, spread

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the published tokenizer cuts a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUNS = (r"\p{L}*+", r"\p{N}*+", r"[^\s\p{L}\p{N}]*+", r"\s*+")


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.split(b"\n")))}


class Merges:
    """The merge list: which tokens fit as neighbours, and how far a continuation can reach back."""

    def __init__(self, ranks: dict[bytes, int], kept: int = 400_000, lookahead: int | None = None):
        self.ranks, self.kept = ranks, kept
        self.longest = max(map(len, ranks))
        #: The longest token that ends in each byte.
        self.longest_to = [0] * 256
        for t in ranks:
            self.longest_to[t[-1]] = max(self.longest_to[t[-1]], len(t))
        #: Tokens that end so many bytes before the end of the text read so far can't change any more.
        self.lookahead = self.sufficient_lookahead() if lookahead is None else lookahead
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def sufficient_lookahead(self) -> int:
        """The longest way that merges, in their order, can carry a difference to the left.

        ``reach[t]``: the longest way after which t may stand right behind the boundary. The merge that makes a token is
        the last one of its own encoding; other ways to cut it never meet, as its bytes would have been merged before."""
        reach = {t: 0 for t in self.ranks if len(t) == 1}
        for token in sorted((t for t in self.ranks if len(t) > 1), key=self.ranks.__getitem__):
            parts = self._merge_strictly(token, self.ranks[token])
            if len(parts) != 2:  # never made by merges
                continue
            u, v = parts
            moved = reach.get(v, 0) + len(u)
            reach[token] = max(reach.get(u, 0), moved)
            reach[u] = max(reach.get(u, 0), moved)
        return max(reach.values(), default=0)

    def _merge_strictly(self, word: bytes, below: int = 1 << 60) -> list[bytes]:
        """The tokens by the definition, least rank first, from the left; only merges of a rank under ``below``."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens can be neighbours. An empty left stands for the start."""
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) > self.kept:
                self._fits.clear()
            known = self._fits[left, right] = self._merge_strictly(left + right) == ([left, right] if left else [right])
        return known


class RunEncoder:
    """The transducer proper, over the bytes of one uncut run. ``emitted`` counts its tokens."""

    def __init__(self, merges: Merges):
        self.m, self.text, self.last = merges, bytearray(), [b""]
        self.before = b""  # the last token emitted
        self.emitted = 0

    def feed(self, data: bytes) -> Iterator[int]:
        m, text, last = self.m, self.text, self.last
        ranks, fits, full = m.ranks, m.fits, 2 * m.lookahead + m.longest
        for b in data:
            text.append(b)
            n = len(text)
            for k in range(min(m.longest_to[b], n), 0, -1):
                token = bytes(text[n - k :])
                if token in ranks and fits(last[n - k] if n > k else self.before, token) and fits(b"", token):
                    last.append(token)
                    break
            if n >= full:
                yield from self._drop(self._stable())

    def _chain(self, end: int) -> list[bytes]:
        tokens = []
        while end > 0:
            tokens.append(self.last[end])
            end -= len(self.last[end])
        return tokens[::-1]

    def _drop(self, tokens: list[bytes]) -> Iterator[int]:
        for t in tokens:
            yield self.m.ranks[t]
        self.emitted += len(tokens)
        if tokens:
            n = sum(map(len, tokens))
            self.before = tokens[-1]
            del self.text[:n]
            del self.last[:n]
            self.last[0] = b""

    def _stable(self) -> list[bytes]:
        """The tokens that end at least the lookahead before the end of the text."""
        tokens, end, least = self._chain(len(self.text)), 0, len(self.text) - self.m.lookahead
        for i, t in enumerate(tokens):
            end += len(t)
            if end > least:
                return tokens[:i]
        return tokens

    def finish(self) -> Iterator[int]:
        yield from self._drop(self._chain(len(self.text)))
        self.text, self.last, self.before = bytearray(), [b""], b""


class Encoder(dict):
    """Texts to ids; as a dict it remembers the ids of runs met before, up to ``kept`` runs of up to 256 characters."""

    def __init__(self, merges: Merges, kept: int = 400_000):
        super().__init__()
        self.m, self.most = merges, kept
        self.cut = regex.compile(PATTERN).findall
        self.runs = [regex.compile(r) for r in _RUNS]
        self.emitted = 0  # tokens made by the transducer, without those remembered

    def __missing__(self, piece: str) -> tuple[int, ...]:
        run = RunEncoder(self.m)
        ids = (*run.feed(piece.encode()), *run.finish())
        self.emitted += run.emitted
        if self.most and len(piece) <= 256:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str, block: int = 1 << 16) -> array:
        """The ids of a text, as a compact array."""
        out = array("i")
        out.extend(self.stream(text[i : i + block] for i in range(0, len(text), block)))
        return out

    def stream(self, blocks: Iterable[str], longest_piece: int = 4096) -> Iterator[int]:
        """The ids of a text that comes in blocks. Memory is bounded by a block and ``longest_piece``."""
        text, kind, run = "", -1, RunEncoder(self.m)
        for block in chain(blocks, (None,)):
            text, ended, at = text + (block or ""), block is None, 0
            if kind >= 0:  # within a run that is too long to be kept
                at = self.runs[kind].match(text).end()
                open_ = at == len(text)
                at -= (kind == 3) and not (open_ and ended) and at > 0
                yield from run.feed(text[:at].encode())
                if open_ and not ended:
                    text = text[at:]
                    continue
                yield from run.finish()
                kind = -1
            pieces = self.cut(text, at)  # they cover the text, so the end of each follows from their lengths
            end, last = len(text), pieces[-1] if pieces else ""
            if not ended:  # what comes may belong to the last pieces
                while pieces and end > len(text) - 3:
                    end -= len(pieces.pop())
            yield from chain.from_iterable(map(self.__getitem__, pieces))
            if not ended and len(last) > longest_piece:
                kind = next(i for i, r in enumerate(self.runs) if r.fullmatch(last, 1))
                keep = len(text) - (kind == 3)
                yield from run.feed(text[end:keep].encode())
                end = keep
            text = text[end:]
        self.emitted += run.emitted


class Decoder:
    """Ids to text as they come; bytes of an unfinished character wait for the next call."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


_encoders: dict[int, Encoder] = {}  # of the worker process, by content of the tokenizer's file
_lookaheads: dict[int, int] = {}  # of the driver, likewise


def _shared_ranks(df: DataFrame, path: str):
    """The tokenizer's file and its lookahead, computed once on the driver and broadcast (under a megabyte)."""
    ship(df)
    with open(path, "rb") as f:
        data = f.read()
    if hash(data) not in _lookaheads:
        _lookaheads[hash(data)] = Merges(load_ranks(data)).lookahead
    return df.sparkSession.sparkContext.broadcast((data, _lookaheads[hash(data)]))


def _encoder(shared) -> Encoder:
    data, lookahead = shared.value
    if hash(data) not in _encoders:
        _encoders.clear()
        _encoders[hash(data)] = Encoder(Merges(load_ranks(data), lookahead=lookahead))
    return _encoders[hash(data)]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; an empty list for an empty or null text.

    Repeated rows and keys stay as they are; other columns are ignored; text of any length is encoded whole."""
    shared = _shared_ranks(df, path)

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            ids, ends = array("i"), [0]
            for t in batch.column(1):
                ids.extend(enc.encode(t.as_py() or ""))
                ends.append(len(ids))
            values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, n_tokens bigint) of every row, by the same transducer."""
    shared = _shared_ranks(df, path)

    def run(batches):
        enc = _encoder(shared)
        for batch in batches:
            n = [len(enc.encode(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, n_tokens bigint")


def decode_ids(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str = TOKENIZER_PATH) -> DataFrame:
    """(key, text) from lists of ids; a null or empty list gives an empty text."""
    shared = _shared_ranks(df, path)

    def run(batches):
        dec = Decoder(load_ranks(shared.value[0]))
        for batch in batches:
            texts = [dec.feed(x or ()) + dec.finish() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
