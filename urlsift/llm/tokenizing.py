"""Token ids of whole texts, by units between spaces with a bounded memo.

Byte-level pre-tokenisation always begins a new pre-token at a space that is followed by a non-space character,
and at a line feed between two non-space characters, so the text can be cut there and the ids of the parts
joined. Most parts repeat, so their ids are kept in a memo of bounded size (two generations, the older is
dropped); only unseen parts reach the merge step.

The merge step is chosen from the vocabulary file when it is loaded. If its merges are listed in the order of
their ids (checked), greedy merging by rank gives the same ids, and the rank encoder of ``tiktoken`` does it;
for every other file, and for characters outside the Latin blocks where case rules differ between libraries,
the ``tokenizers`` library encodes the part itself.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array

MEMO_ENTRIES = 150_000  # per generation and Python worker
MEMO_UNIT_CHARS = 64  # longer units are encoded each time, so an entry's size is bounded

# how byte-level vocabularies write bytes as characters: printable Latin-1 stays, the rest moves past U+0100
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> dict[str, int]:
    out = {chr(b): b for b in _PRINTABLE}
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo(dict):
    """``memo[unit]`` gives ``encode(unit)`` and keeps at most two generations of ``entries`` units."""

    def __init__(self, encode, entries: int = MEMO_ENTRIES):
        super().__init__()
        self._encode, self._entries, self._old = encode, entries, {}

    def __missing__(self, unit: str) -> bytes:
        found = self._old.get(unit)
        if found is None:
            found = self._encode(unit)
            if len(unit) > MEMO_UNIT_CHARS:
                return found
        if len(self) >= self._entries:
            self._old = dict(self)
            self.clear()
        self[unit] = found
        return found


_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _single_spaced(text: str) -> bool:
    """Whether spaces and line feeds all stand alone between other characters and there is no further white space."""
    return not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
                or any([c in text for c in _RARE_SPACE]) or not text.isascii() and any([c in text for c in _WIDE_SPACE]))


_CUT = re.compile(r" (?=\S)")


class UnitIds:
    """Ids of texts under byte-level pre-tokenisation as little-endian 32-bit integers. ``encode`` gives those of a
    unit, ``encode_spaced`` those of a unit with a space before it (by default ``encode`` of both); units behind a
    space have a memo of their own, ``spaced``, so the space is added only for unseen ones."""

    def __init__(self, encode, encode_spaced=None, entries: int = MEMO_ENTRIES):
        self._plain, self.spaced = Memo(encode), Memo(encode_spaced or (lambda unit: encode(" " + unit)), entries)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        plain, spaced = self._plain.__getitem__, self.spaced.__getitem__
        if _single_spaced(text):
            feed = plain("\n") if "\n" in text else b""
            lines = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                lines.append(plain(first) + b"".join(map(spaced, rest)))
            return feed.join(lines)
        first, *rest = _CUT.split(text)
        return (plain(first) if first else b"") + b"".join(map(spaced, rest))


def _pack(ids) -> bytes:
    return array("I", ids).tobytes()


class SpecialTokens:
    """Ids of texts that may spell added tokens of a ``tokenizer.json``: those get their own ids, as the library gives
    them, and the parts between go to ``parts``. Tokens with options of their own leave such texts to the library."""

    def __init__(self, spec: dict, tokenizer, parts):
        added = spec.get("added_tokens") or []
        self._ids = {t["content"]: _pack([t["id"]]) for t in added if t["content"]}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._ids, key=len, reverse=True))) + ")").split
        self._bare = not any(t.get(option) for t in added for option in ("single_word", "lstrip", "rstrip", "normalized"))
        self._tok, self._parts = tokenizer, parts

    def __call__(self, text: str) -> bytes:
        if not any([t in text for t in self._ids]):
            return self._parts(text)
        if not self._bare:
            return _pack(self._tok.encode(text, add_special_tokens=False).ids)
        return b"".join([self._ids[part] if k % 2 else self._parts(part) for k, part in enumerate(self._split(text))])


class ByteLevelEncoder:
    """Ids by a byte-level BPE ``tokenizer.json``; none are added, and special tokens spelled in a text get their ids."""

    def __init__(self, path: str, pattern: str):
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tok = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._ranks = self._rank_encoder(spec, pattern)
        self.ids = SpecialTokens(spec, self._tok, UnitIds(self._encode_unit))

    @staticmethod
    def _rank_encoder(spec: dict, pattern: str):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout"))
        if not plain:
            return None
        alphabet, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != list(range(256, 256 + len(ids))):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode_unit(self, unit: str) -> bytes:
        if self._ranks is not None:
            return _pack(self._ranks.encode_ordinary(unit))
        return _pack(self._tok.encode(unit, add_special_tokens=False).ids)


MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII characters that are neither letters, digits nor white space


class WordEndEncoder:
    """Ids by a lower-casing BPE ``tokenizer.json`` with word-end marks, which drops white space.

    A word-end symbol is written as the byte 0xFF (never part of UTF-8): joining it to the last byte of a word
    gets the lowest ranks, so that join always happens first, as the vocabulary's own initial symbols have it."""

    _PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tok = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._split = regex.compile(self._PIECES).findall
        self._core, self._to_id = self._rank_encoder(spec)
        self._code = self._core and self._core._core_bpe.encode_single_piece
        self._memo = Memo(self._encode_unit, 2 * MEMO_ENTRIES)
        self.ids = SpecialTokens(spec, self._tok, self._units)

    def _rank_encoder(self, spec: dict):
        import tiktoken

        model, end = spec["model"], spec["model"].get("end_of_word_suffix")
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if end != "</w>" or normal != ["NFC", "Replace", "Lowercase"] or splits[:1] != [self._PIECES]:
            return None, None
        alphabet, vocab = byte_alphabet(), model["vocab"]

        def raw(token: str) -> bytes:
            done = token.endswith(end) and token != end
            return bytes(alphabet[c] for c in (token[: -len(end)] if done else token)) + b"\xff" * done

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        to_id = [vocab.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        to_id += [vocab.get(c + end, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            if (key := raw(a + b)) not in ranks:
                ranks[key] = len(to_id)
                to_id.append(vocab[a + b])
        return tiktoken.Encoding("word-ends", pat_str=r".+", mergeable_ranks=ranks, special_tokens={}), [_pack([max(i, 0)]) for i in to_id]

    def _encode_unit(self, unit: str) -> bytes:
        if not unit:
            return b""
        if unit.isascii():
            text = unit.lower()
        elif self._core is None or max(unit) > "ɏ":
            return _pack(self._tok.encode(unit, add_special_tokens=False).ids)
        else:
            text = unicodedata.normalize("NFC", unit).lower()
        if self._core is None:
            return _pack(self._tok.encode(unit, add_special_tokens=False).ids)
        code, to_id = self._code, self._to_id
        if text.isalpha():
            return b"".join([to_id[r] for r in code(text.encode() + b"\xff")])
        word = text.rstrip(MARKS)
        if word != text and word.isalpha():  # a word with marks behind it: two pieces, the marks a common one
            return b"".join([to_id[r] for r in code(word.encode() + b"\xff")]) + self._memo[text[len(word):]]
        return b"".join([to_id[r] for piece in self._split(text) for r in code(piece.encode() + b"\xff")])

    def _units(self, text: str) -> bytes:
        return b"".join(map(self._memo.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[tuple, object] = {}


def encoder(kind: type, *args: str):
    """One encoder, with its memo, per Python worker and vocabulary."""
    key = (kind, *args)
    if key not in _LOADED:
        gc.set_threshold(500_000, 50, 1000)  # memos hold many small objects and no cycles
        _LOADED[key] = kind(*args)
    return _LOADED[key]
