"""Token ids and token counts of whole texts with a byte-level BPE vocabulary.

A byte-level BPE of this family first cuts a text by a fixed pattern and then
merges inside the pieces.  Where white space begins after a non-white character
there is always such a cut: no piece holds white space after other characters,
and what the pattern does with a run of white space depends on that run and on
what follows it only.  So does the pattern cut between ASCII letters, digits and
punctuation (but for what follows an apostrophe), and between an ideograph and
the full-width punctuation after it.  Texts longer than ``LONG`` bytes are cut at
the last such place before each ``LONG`` bytes (or the first after it) that lies
in no special token's string; counts and ids of the parts add up.

A stretch of over ``2 * LONG`` bytes without such a place (one letter over and
over, a line of dashes, prose without marks) is one piece of the pattern.  It is
encoded in overlapping parts: a sequence of tokens is the merge result of its
text if each two neighbours are that of theirs (Berglund and van der Merwe, 2023),
so a part that begins at a token of the part before, and begins with the same
token, goes on where the two meet.  Where no such token is found the stretch is
encoded whole.  So memory is bounded by the slice and a part, whatever the text.

Inside a part each single space between non-white characters is such a place
too.  Parts without other spaces and special strings are split there, each
distinct chunk of a batch is encoded once in one ``encode_batch`` call of the
tokenizers library, and ids or lengths are gathered with numpy.  Other parts
are encoded as they are by the same library.

Chunks are kept per worker in a bounded cache: when it is full it is emptied,
never trimmed by guess, so results do not depend on it.
"""

from __future__ import annotations

import json
import re
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_CHUNKS = 700_000
_WHITE = r"[\s\pZ\x{0b}\x{1c}-\x{1f}\x{85}]"
_UNSAFE = rf"(^|{_WHITE}) ({_WHITE}|$)"
RUN_CHUNKS = 100_000
LONG, PART_BYTES = 1 << 18, 2 << 20
SEAM, TRIES = 4096, 12
"""Characters of a part's end that are left to the next part, and places tried for its beginning."""
_SPACE, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGIT[range(0x30, 0x3A)] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_WIDE_MARKS = [c.encode() for c in "、。，！？：；「」《》（）"]
_TURN = re.compile(r"[\s'\x1c-\x1f\x85]")
"""Where the pattern may look at what stands before: no part begins next to these."""
_WIDE_SPACES = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Where a text's bytes may be cut without a change of its tokens."""
    white = _SPACE[raw]
    for code in _WIDE_SPACES:
        last = raw == code[-1]
        for k, byte in enumerate(reversed(code[:-1]), 1):
            last[k:] &= raw[:-k] == byte
            last[:k] = False
        white |= last  # the last byte of a wide space: what follows it does not begin a run
    begins = _SPACE[raw[1:]] & ~white[:-1]
    kind = (_LETTER + 2 * _DIGIT + 4 * _MARK)[raw]
    turns = (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0) & ((raw[:-1] != 0x27) | (kind[1:] != 1))
    begins |= turns
    if len(raw) > 6:
        for code in _WIDE_MARKS:  # after U+5000 to U+8FFF, all of them letters
            at = (raw[3:-2] == code[0]) & (raw[4:-1] == code[1]) & (raw[5:] == code[2])
            begins[2:-2] |= at & (raw[:-5] >= 0xE5) & (raw[:-5] <= 0xE8)
    return np.flatnonzero(begins) + 1


def parts_of(text: bytes, special: list[bytes] = []) -> list[bytes]:  # noqa: B006
    """A long text in parts of about ``LONG`` bytes; no string of ``special`` is cut."""
    cuts, out, at = safe_places(np.frombuffer(text, np.uint8)), [], 0
    for name in special:
        found = text.find(name)
        if found >= 0:
            starts = np.array([m.start() for m in re.finditer(b"(?=" + re.escape(name) + b")", text)])
            before = np.searchsorted(starts, cuts, side="left") - 1
            cuts = cuts[(before < 0) | (starts[before] + len(name) <= cuts)]
    while len(text) - at > LONG:
        j = int(np.searchsorted(cuts, at + LONG, side="right"))
        cut = cuts[j - 1] if j and cuts[j - 1] > at else cuts[j] if j < len(cuts) else len(text)
        out.append(text[at:cut])
        at = int(cut)
    return [*out, text[at:]] if at < len(text) else out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


class Encoder:
    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path))
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex", True)
        self.splits = bool(plain)
        """Whether the cut before a space is safe for this vocabulary."""
        self.special_bytes = [c.encode() for c in self.special]
        self.cuts = self.splits and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        names = spec["model"]["vocab"]
        self.token_bytes = np.zeros(max([*names.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        self.token_bytes[list(names.values())] = [len(n) for n in names]
        self.chunks: dict[str, int] = {}
        self.heads: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 12, np.int64)

    def _add(self, fresh: list[str], spaced: bool) -> None:
        """Encode new chunks: in long runs where they may stand side by side, else alone."""
        run, alone = [], [] if spaced else fresh
        for c in fresh if spaced else ():
            (alone if c[-1:].isspace() or not c else run).append(c)
        sizes, flats = [], []
        for lo in range(0, len(run), RUN_CHUNKS):
            some = run[lo : lo + RUN_CHUNKS]
            ids = np.asarray(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(pc.binary_length(pa.array(some)).to_numpy(zero_copy_only=False) + 1)
            until = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
            sizes.append(np.diff(until, prepend=0))
            flats.append(ids)
        if alone:
            encoded = [e.ids for e in self.library.encode_batch_fast([" " * spaced + c for c in alone], add_special_tokens=False)]
            sizes.append(np.array([len(ids) for ids in encoded]))
            flats.append(np.fromiter((i for ids in encoded for i in ids), np.int32))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        known = len(self.chunks) + len(self.heads)
        end = int(self.ends[known])
        self.ids = _room(self.ids, end + len(flat))
        self.ids[end : end + len(flat)] = flat
        self.ends = _room(self.ends, known + 1 + len(size))
        self.ends[known + 1 : known + 1 + len(size)] = end + np.cumsum(size)
        (self.chunks if spaced else self.heads).update(zip(run + alone, range(known, known + len(size))))

    def _numbers(self, names: list[str], spaced: bool) -> np.ndarray:
        have = self.chunks if spaced else self.heads
        found = list(map(have.get, names))
        if fresh := [n for n, k in zip(names, found) if k is None]:
            self._add(fresh, spaced)
            found = [have[n] if k is None else k for n, k in zip(names, found)]
        return np.array(found, np.int64)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk numbers of safe texts in a row, chunks per text, and the bounds of every chunk's ids."""
        parts = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        first = (np.cumsum(counts) - counts)[counts > 0]
        if len(self.chunks) + len(self.heads) + len(names) + len(first) > CACHE_CHUNKS:
            self.chunks, self.heads = {}, {}
        # All chunks but a text's first begin with the space they were split at.
        number = self._numbers(names, True)[codes] if names else np.zeros(0, np.int64)
        heads, where = np.unique(codes[first], return_inverse=True)
        number[first] = self._numbers([names[i] for i in heads], False)[where]
        return number, counts, self.ends[: len(self.chunks) + len(self.heads) + 1]

    def _safe(self, texts: pa.Array) -> np.ndarray:
        odd = pc.match_substring_regex(texts, _UNSAFE)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        short = pc.less_equal(pc.binary_length(texts), 2 * LONG)
        return pc.and_not(short, odd).to_numpy(zero_copy_only=False) if self.splits else np.zeros(len(texts), bool)

    def _whole(self, text: str) -> list[int]:
        """The ids of a text that is not chunked, a long one in overlapping parts."""
        ids: list[int] = []
        at, shared = 0, None
        size = LONG  # characters
        while self.cuts and len(text) - at > 2 * size:
            found = self.library.encode(text[at : at + size], add_special_tokens=False)
            if shared is None:
                ids += found.ids[:1]
            step = self._seam(text, at, found)
            if step is None:
                return self.library.encode(text, add_special_tokens=False).ids
            k, place = step
            ids += found.ids[1 : k + 1]
            at, shared = place, found.ids[k]
        rest = self.library.encode(text[at:], add_special_tokens=False).ids
        return ids + rest[shared is not None :]

    def _seam(self, text: str, at: int, found) -> tuple[int, int] | None:
        """A token of a part, and its place in the text, from which the next part goes on with it."""
        spans, k = found.offsets, len(found.ids)
        until = spans[-1][1] - SEAM
        for _ in range(TRIES):
            k -= 1
            while k > 0 and (spans[k][0] > until or spans[k][0] != spans[k - 1][1] or spans[k][0] < 4 or _TURN.search(text, at + spans[k][0] - 3, at + spans[k][0] + 1)):
                k -= 1
            if k <= 0:
                return None
            place = at + spans[k][0]
            # The next part as it will be: of the same length, or all the rest.
            left = len(text) - place
            head = self.library.encode(text[place : place + LONG] if left > 2 * LONG else text[place:], add_special_tokens=False)
            if head.ids[0] == found.ids[k] and head.offsets[0][1] + spans[k][0] == spans[k][1]:
                return k, place
            k -= 7
        return None

    def _parts(self, texts: pa.Array) -> tuple[list[pa.Array], np.ndarray | None]:
        """The texts with long ones cut, in runs of bounded size, and each part's text."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if not self.cuts or not (sizes > LONG).any():
            return [texts], None
        owner, runs, run, held = [], [], [], 0
        for i, size in enumerate(sizes):
            for part in parts_of(texts[i].as_py().encode(), self.special_bytes) if size > LONG else [texts[i].as_py().encode()]:
                if run and held + len(part) > PART_BYTES:
                    runs.append(pa.array(run, pa.binary()).cast(pa.string()))
                    run, held = [], 0
                run.append(part)
                held += len(part)
                owner.append(i)
        return [*runs, pa.array(run, pa.binary()).cast(pa.string())], np.array(owner)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; null is empty."""
        texts = texts.fill_null("")
        runs, owner = self._parts(texts)
        done = [self._encode(run) for run in runs]
        if owner is None:
            return done[0]
        sizes = np.concatenate([lengths for _, lengths in done])
        return np.concatenate([ids for ids, _ in done]), np.bincount(owner, sizes, len(texts)).astype(np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text, without making the ids."""
        texts = texts.fill_null("")
        runs, owner = self._parts(texts)
        sizes = np.concatenate([self._count(run) for run in runs])
        return sizes if owner is None else np.bincount(owner, sizes, len(texts)).astype(np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        safe = self._safe(texts)
        number, counts, ends = self._chunked(texts.filter(pa.array(safe)))
        size = np.diff(ends)
        lengths = np.zeros(len(texts), np.int64)
        owner = np.repeat(np.flatnonzero(safe), counts)
        lengths += np.bincount(owner, size[number], len(texts)).astype(np.int64)
        odd = np.flatnonzero(~safe)
        whole = [np.asarray(self._whole(texts[i].as_py()), np.int32) for i in odd]
        lengths[odd] = [len(w) for w in whole]
        out = np.empty(int(lengths.sum()), np.int32)
        starts = np.cumsum(lengths) - lengths
        for i, w in zip(odd, whole):
            out[starts[i] : starts[i] + len(w)] = w
        n = size[number]
        take = np.repeat(ends[number] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        is_safe = np.repeat(safe, lengths)
        out[is_safe] = self.ids[take]
        return out, lengths

    def _count(self, texts: pa.Array) -> np.ndarray:
        safe = self._safe(texts)
        number, counts, ends = self._chunked(texts.filter(pa.array(safe)))
        owner = np.repeat(np.flatnonzero(safe), counts)
        lengths = np.bincount(owner, np.diff(ends)[number], len(texts)).astype(np.int64)
        odd = ~safe
        long_ = pc.greater(pc.binary_length(texts), 2 * LONG).to_numpy(zero_copy_only=False)
        lengths[odd & long_] = [len(self._whole(texts[i].as_py())) for i in np.flatnonzero(odd & long_)]
        odd &= ~long_
        lengths[odd] = [len(e.ids) for e in self.library.encode_batch_fast([texts[i].as_py() for i in np.flatnonzero(odd)], add_special_tokens=False)]
        return lengths


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    stash = sys.modules.setdefault("_ledgerlake_encoders", SimpleNamespace(by_path={}))
    if path not in stash.by_path:
        stash.by_path[path] = Encoder(path)
    return stash.by_path[path]
