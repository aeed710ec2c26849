"""Texts that spell special tokens get the ids the tokenizers library gives them, parts between them as ever."""

import random

import pytest

from urlsift.llm.queries import split_pattern, vocabulary
from urlsift.llm.tokenizing import ByteLevelEncoder, SpecialTokens, WordEndEncoder

PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "<|", "|>", " ", "  ", "\n", "\t", "word", " it's", "Été", "日本", "é", "12", "."]


@pytest.mark.parametrize(("kind", "args"), [(ByteLevelEncoder, ("byte_bpe_50k.json",)), (WordEndEncoder, ("word_bpe_49k.json",))])
def test_ids_equal_the_library(kind, args):
    from tokenizers import Tokenizer

    path = vocabulary(*args)
    enc = kind(path, split_pattern()) if kind is ByteLevelEncoder else kind(path)
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    seen = set()
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(12)))
        ids = memoryview(enc.ids(text)).cast("I").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        seen.update(ids)
    assert max(seen) in (50256, 49407)


def test_tokens_with_options_go_to_the_library():
    class Library:
        def encode(self, text, add_special_tokens):
            self.ids = [len(text)]
            return self

    spec = {"added_tokens": [{"content": "<x>", "id": 7, "lstrip": True}]}
    ids = SpecialTokens(spec, Library(), lambda text: b"parts")
    assert ids("a b") == b"parts" and ids("a <x>") == b"\x05\0\0\0"
