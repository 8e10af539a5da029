"""Long texts in any script go through the token encoder in bounded parts, with the library's ids."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(17)
HAN = [chr(c) for c in range(0x5000, 0x8FFF, 3)]
CASES = {
    "prose without spaces": lambda n: "".join(rng.choice(HAN) if rng.random() < 0.93 else rng.choice("，。、！？") for _ in range(n // 3)),
    "ideographs alone": lambda n: "".join(rng.choice(HAN[:40]) for _ in range(n // 3)),
    "one letter": lambda n: "a" * n,
    "two letters": lambda n: "".join(rng.choice("ab") for _ in range(n)),
    "syllables": lambda n: "".join(rng.choice(("the", "ing", "tion", "er", "s", "re", "in")) for _ in range(n // 3)),
    "one mark": lambda n: "-" * n,
    "marks": lambda n: "".join(rng.choice("-=_!'*#'") for _ in range(n)),
    "contractions": lambda n: "".join(rng.choice(("x's", "'re", "''ll", "'S", "we've")) for _ in range(n // 4)),
    "digits": lambda n: "".join(rng.choice("0123456789") for _ in range(n)),
    "special strings": lambda n: "".join(rng.choice(("a1", "<|endoftext|>", "<|", "|>", "endoftext")) for _ in range(n // 6)),
    "other script": lambda n: "".join(chr(rng.randrange(0x0400, 0x0460)) for _ in range(n // 2)),
    "white space": lambda n: " " * (n // 2) + "\n" * (n // 2) + "x",
    "wide spaces": lambda n: "　".join("".join(rng.choice(HAN) for _ in range(9)) for _ in range(n // 30)),
    "emoji": lambda n: "".join(rng.choice(("👩‍👩‍👧", "🏳️‍🌈", "é", "Ⅷ", "½")) for _ in range(n // 8)),
}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("name", CASES)
def test_ids_of_long_texts(library, monkeypatch, name):
    monkeypatch.setattr(tokens, "LONG", 6000)
    monkeypatch.setattr(tokens, "SEAM", 200)
    code = tokens.Encoder(PATH)
    texts = [CASES[name](60_000), "short one", CASES[name](20_000), None, CASES[name](13_000) + " tail"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, lengths = code.encode(pa.array(texts, pa.string()))
    flat = iter(ids.tolist())
    assert [[next(flat) for _ in range(n)] for n in lengths] == want
    assert code.count(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", ["prose without spaces", "ideographs alone", "one letter", "one mark", "other script"])
def test_parts_are_bounded(library, monkeypatch, name):
    """Two megabytes: no call of the library sees more than a few parts' length."""
    code, seen = tokens.Encoder(PATH), []

    class Watched:
        def encode(self, text, **kwargs):
            seen.append(len(text.encode()))
            return library.encode(text, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            seen.append(sum(len(t.encode()) for t in texts))
            return library.encode_batch_fast(texts, **kwargs)

    text = CASES[name](2_000_000)
    code.library = Watched()
    count = code.count(pa.array([text]))
    assert count.tolist() == [len(library.encode(text, add_special_tokens=False).ids)]
    assert max(seen) <= 3 * tokens.PART_BYTES // 2 and (name == "prose without spaces" or max(seen) <= 7 * tokens.LONG)


def test_no_special_string_is_cut():
    name = b"<s1>"
    text = b"x1<s1>y2<s1><s1>ab12!?z"
    parts = tokens.parts_of(text * 40_000, [name])
    assert len(parts) > 2 and b"".join(parts) == text * 40_000 and sum(p.count(name) for p in parts) == 120_000
