"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

The merge list is read as a nondeterministic transducer over bytes: it walks the trie of token bytes and, at the end
of a token, may emit it if the token can follow the one before (no merge across their border would have happened
first). Exactly one path survives for any text. Determinisation turns the set of live paths into one state, with the
tokens they agree on emitted at once and the rest kept as residual output, so a token leaves after bounded lookahead.
States and transitions are made the first time a byte needs them and kept in a table of bounded size, which is
dropped and begun anew when full. Work is linear in the length of a piece, however long it is.

Decoding looks token bytes up and feeds them, in chunks, to an incremental UTF-8 machine whose state is the bytes of
a character that is not yet complete, so a character split over tokens or chunks comes out whole.

Scale. Encoding is one narrow pass over the texts (Arrow batches, no shuffle); per worker it holds the tables, the
state cache and a memo of units, all bounded. Very long texts cost memory in proportion to that text alone.

Defined results. Null or empty text: no ids, and the digest of nothing. Ids repeat or are null freely, since rows are
independent. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from urlsift.llm.common import id_text
from urlsift.llm.tokenizing import MARKS, Memo, UnitIds, _pack, encoder

MAX_STATES = 300_000
MAX_BORDERS = 1_000_000
UNIT_ENTRIES = 400_000  # per generation of the memo of words behind a space
PIECE_ENTRIES = 50_000  # per generation of the memo of other pieces
LAST_LATIN = "\u024f"  # up to here every library has the same letters
DECODE_CHUNK = 8192


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.max_states = max_states
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int | None] = [None]
        for token, rank in ranks.items():
            self._add(token, rank)
        self._split: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, list[tuple[bytes, float]]] = {}
        self._border: dict[int, bool] = {}
        self._forget()

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for b in token:
            nxt = self._children[node].get(b)
            if nxt is None:
                nxt = self._children[node][b] = len(self._children)
                self._children.append({})
                self._token.append(None)
            node = nxt
        self._token[node] = rank

    # -- which tokens may stand side by side --------------------------------------------------------------------
    def _merge(self, parts: list[bytes], below: float) -> list[bytes]:
        """Merge adjacent parts by rank, leftmost of the lowest first, using ranks under ``below`` only."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte, (-1, -1) if merging its bytes does not
        lead to it."""
        if token not in self._split:
            raw = self.bytes_of[token]
            if len(raw) == 1:
                self._split[token] = None
            else:
                parts = self._merge([raw[k:k + 1] for k in range(len(raw))], token)
                self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
        return self._split[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The tokens that stand at the border on the way to ``token``, each with the rank at which it is merged away."""
        known = self._edges.get(token << 1 | side)
        if known is None:
            known, at, until = [], token, float("inf")
            while True:
                known.append((self.bytes_of[at], until))
                halves = self._halves(at)
                if halves is None:
                    break
                at, until = halves[side], at
            self._edges[token << 1 | side] = known
        return known

    def _survives(self, left: int, right: int) -> bool:
        """Whether the border between the two survives: no merge across it comes before both have their final form.
        At equal rank the leftmost merge goes first, so one inside ``left`` wins against the border and the border
        against one inside ``right``."""
        get = self.ranks.get
        for a, a_until in self._edge(left, 1):
            for b, b_until in self._edge(right, 0):
                across = get(a + b)
                if across is not None and across < a_until and across <= b_until:
                    return False
        return True

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._border.get(key)
        if known is None:
            if len(self._border) >= MAX_BORDERS:
                self._border.clear()
            known = self._border[key] = self._survives(left, right)
        return known

    # -- lazily determinised states -----------------------------------------------------------------------------
    def _forget(self) -> None:
        start = ((0, -1, ()),)
        self._states, self._ids, self._next = [start], {start: 0}, {}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A state is a set of (trie node, token before, residual output); returns (state, tokens all paths agree on)."""
        paths, children, tokens, border = [], self._children, self._token, self._border
        for node, last, held in self._states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                paths.append((child, last, held))
            token = tokens[child]
            if token is None:
                continue
            if last >= 0:
                fits = border.get(last << 20 | token)
                if fits is None:
                    fits = self._may_follow(last, token)
                if not fits:
                    continue
            if token not in self._split and self._halves(token) == (-1, -1):
                tokens[child] = None  # no merge order leads to it
                continue
            paths.append((0, token, (*held, token)))
        agreed = 0  # tokens that all residual outputs begin with
        outputs = [p[2] for p in paths]
        first = outputs[0]
        if all(outputs):
            while all([len(o) > agreed and o[agreed] == first[agreed] for o in outputs if len(first) > agreed] or [False]):
                agreed += 1
        shared = first[:agreed]
        settled = tuple([(node, last, held[agreed:]) for node, last, held in paths]) if agreed else tuple(paths)
        known = self._ids.get(settled)
        if known is None:
            known = self._ids[settled] = len(self._states)
            self._states.append(settled)
        return known, shared

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > self.max_states:
            self._forget()
        out, state, table = [], 0, self._next
        for b in piece[:-1]:
            key = state << 8 | b
            hop = table.get(key)
            if hop is None:
                hop = table[key] = self._step(state, b)
            state = hop[0]
            if hop[1]:
                out += hop[1]
        return out + self._finish(state, piece[-1])

    def _finish(self, state: int, byte: int) -> list[int]:
        """The output of the one path that ends with the last byte of a piece; no state is made for what cannot go on."""
        for node, last, held in self._states[state]:
            child = self._children[node].get(byte)
            token = None if child is None else self._token[child]
            if token is None or last >= 0 and not self._may_follow(last, token):
                continue
            if token not in self._split and self._halves(token) == (-1, -1):
                self._token[child] = None
                continue
            return [*held, token]
        raise ValueError("bytes that the vocabulary cannot express")


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the text that is complete, the state is the unfinished character."""

    def __init__(self):
        self._held = b""

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self._held + data
        cut = len(data) if last else self._complete(data)
        self._held = data[cut:]
        return data[:cut].decode("utf-8", "surrogateescape")

    @staticmethod
    def _complete(data: bytes) -> int:
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: 2, 3 or 4 bytes belong together
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return len(data) - back if need > back else len(data)
            if b < 0x80:
                break
        return len(data)


def _words_are_pieces(split) -> bool:
    """Whether the pattern takes a space and the Latin letters behind it as one piece and ASCII marks after them as
    another, for every letter and mark and in longer runs."""
    letters = [c for c in map(chr, range(ord(LAST_LATIN) + 1)) if c.isalpha()]
    words = [" " + a + b for a in letters for b in ("", "s", "é", "Z")] + [" " + "".join(letters), " " + "ab" * 500]
    marks = [*MARKS, MARKS, MARKS[::-1], *(a + b for a in MARKS for b in MARKS)]
    return (all(split(w) == [w] for w in words)
            and all(split(f" {w}{m}") == [f" {w}", m] for m in marks for w in ("a", "abZ", "é")))


class TransducerCodec:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.transducer = MergeTransducer(ranks)
        self._pieces = regex.compile(pattern).findall
        self._ids = UnitIds(self._encode_unit, self._encode_spaced if _words_are_pieces(self._pieces) else None, UNIT_ENTRIES)
        self._piece_ids = Memo(self._encode_piece, PIECE_ENTRIES)
        self._bytes = [self.transducer.bytes_of.get(r, b"") for r in range(max(ranks.values()) + 1)]
        self._decimal = [str(r) for r in range(len(self._bytes))]

    def _encode_unit(self, unit: str) -> bytes:
        return b"".join(map(self._piece_ids.__getitem__, self._pieces(unit)))

    def _encode_spaced(self, unit: str) -> bytes:
        """A unit behind a space; a word, or a word with marks behind it, is split without the pattern."""
        if unit.isascii() or max(unit) <= LAST_LATIN:
            if unit.isalpha():
                return _pack(self.transducer.encode_piece(b" " + unit.encode()))
            word = unit.rstrip(MARKS)
            if word != unit and word.isalpha():
                return self._ids.spaced[word] + self._piece_ids[unit[len(word):]]
        return self._encode_unit(" " + unit)

    def _encode_piece(self, piece: str) -> bytes:
        return _pack(self.transducer.encode_piece(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._ids(text), np.uint32).tolist()

    def decode_stream(self, ids: list[int]):
        stream, get = Utf8Stream(), self._bytes.__getitem__
        for k in range(0, len(ids), DECODE_CHUNK):
            yield stream.feed(b"".join(map(get, ids[k:k + DECODE_CHUNK])))
        yield stream.feed(b"", last=True)

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream(ids))

    def ids_digest(self, ids: list[int]) -> str:
        return hashlib.sha256(" ".join(map(self._decimal.__getitem__, ids)).encode()).hexdigest()

    def decoded_digest(self, ids: list[int]) -> str:
        h = hashlib.sha256()
        for text in self.decode_stream(ids):
            h.update(text.encode("utf-8", "surrogateescape"))
        return h.hexdigest()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids array<int>`` of every whole text."""
    return _per_text(docs, ranks_path, pattern, id_col, text_col, {"ids": (pa.list_(pa.int32()), "array<int>", lambda codec, ids: ids)})


def decode_documents(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``<id_col>, text`` from id lists (null list: empty text)."""
    source = coded.select(coded[id_col].alias("id"), coded[ids_col].alias("ids"))

    def run(batches):
        codec = encoder(TransducerCodec, ranks_path, pattern)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, text string")


def code_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_tokens, ids_sha256, decoded_sha256``: each text encoded, its ids decoded again, both digested."""
    return _per_text(docs, ranks_path, pattern, id_col, text_col, {
        "n_tokens": (pa.int64(), "long", lambda codec, ids: len(ids)),
        "ids_sha256": (pa.string(), "string", lambda codec, ids: codec.ids_digest(ids)),
        "decoded_sha256": (pa.string(), "string", lambda codec, ids: codec.decoded_digest(ids))})


def _per_text(docs, ranks_path, pattern, id_col, text_col, columns) -> DataFrame:
    source = id_text(docs, id_col, text_col)

    def run(batches):
        codec = encoder(TransducerCodec, ranks_path, pattern)
        for batch in batches:
            out = {name: [] for name in columns}
            for text in batch.column(1):  # one text at a time: ids of a batch are not held together
                ids = codec.encode(text.as_py())
                for name, (_, _, take) in columns.items():
                    out[name].append(take(codec, ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[n], kind) for n, (kind, _, _) in columns.items())], names=[id_col, *columns])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} {sql}" for n, (_, sql, _) in columns.items())]))
