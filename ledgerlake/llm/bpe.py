"""BPE encoding and decoding with a segment tree over pair ranks (operator 11).

A text is cut at special tokens, normalised and cut into words as the vocabulary
file says; a word's bytes are its first symbols.  A segment tree stands over the
ranks of adjacent symbol pairs, each joined with its place, so that its root
yields the leftmost pair of the lowest rank.  That pair is merged: its right
symbol's leaf is emptied, the leaves before and at the merged symbol get their
new ranks, each in logarithmic time, until the root has no pair left.  A word of
n symbols costs O(n log n), however long it is.  The new words of a slice share
one step: a forest of such trees, one row of an array a word, in which every root
gives its merge and every merge its point updates at once; words of more than
``FOREST`` letters have a tree of their own.

Vocabularies with the usual rules of ``PLAIN`` (NFC, white space, lower case,
one fixed pattern) drop all white space and join nothing across it; texts are
split at ASCII white space first and each distinct chunk of a slice is encoded
once, pure ASCII ones without the library's normaliser.  Other chunks pass the
normaliser and the pre-tokenizer of the library, whose character tables decide
what a letter is, many in one call; merging and decoding are done here for all.

Decoding maps ids to tokens and undoes the byte alphabet where the vocabulary
has a byte-level decoder; without a decoder the tokens are joined by a space.

Scale: one narrow stage, texts in slices balanced by bytes; caches are bounded
and emptied when full, so results do not depend on them.

Defined results: a null text is encoded as an empty one (no ids, an empty
decoding); special strings in a text become their special ids, as is the
library's default; repeated rows are encoded alike; an empty table gives an
empty table; other columns are carried, those named like an output replaced.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import carried, restored
from .words import slices
from .workers import lean

SLICE_BYTES = 4 << 20
CACHE_CHUNKS, CACHE_WORDS, CACHE_IDS = 500_000, 500_000, 1 << 23
FOREST = 64
#: The normaliser and pattern under which words never hold white space.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased ASCII without white space.
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
_WHITE, _CONTROL = re.compile(r"[\s\x85\xa0]"), re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")
_STEP = 1 << 20
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: itself where it is printable in
    Latin-1, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """``symbols`` after all merges. ``ranks``: of a pair ``left * 2**20 + right``; ``merged``: by rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    depth = (n - 2).bit_length()
    leaves = 1 << depth
    tree = [_NONE] * (2 * leaves)
    for i in range(n - 1):
        rank = ranks.get(symbols[i] * _STEP + symbols[i + 1])
        if rank is not None:
            tree[leaves + i] = rank << depth | i
    for x in range(leaves - 1, 0, -1):
        a, b = tree[2 * x], tree[2 * x + 1]
        tree[x] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) != _NONE:
        i = top & (leaves - 1)
        j = after[i]
        k = after[i] = after[j]
        symbols[i], symbols[j] = merged[top >> depth], -1
        points = [(j, _NONE)] if j < n - 1 else []
        rank = None
        if k < n:
            before[k] = i
            rank = ranks.get(symbols[i] * _STEP + symbols[k])
        points.append((i, _NONE if rank is None else rank << depth | i))
        if (h := before[i]) >= 0:
            rank = ranks.get(symbols[h] * _STEP + symbols[i])
            points.append((h, _NONE if rank is None else rank << depth | h))
        for place, value in points:
            x = leaves + place
            tree[x] = value
            while x > 1:
                x >>= 1
                a, b = tree[2 * x], tree[2 * x + 1]
                if a > b:
                    a = b
                if tree[x] == a:
                    break
                tree[x] = a
    return [s for s in symbols if s >= 0]


class Ranks:
    """Ranks of symbol pairs, looked up by whole arrays; NONE where a pair has no merge."""

    def __init__(self, ranks: dict[int, int], merged: list[int]) -> None:
        pairs = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], _NONE)
        self.ranks = np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], 0)
        self.merged = np.array(merged or [0], np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of each pair: its rank joined with its place."""
        pair = left * _STEP + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at] << depth | place, _NONE)


def merge_forest(symbols: np.ndarray, n: np.ndarray, ranks: Ranks) -> np.ndarray:
    """``merge`` for many words, a row of ``symbols`` each with ``n`` of them; -1 marks what is gone."""
    many, width = symbols.shape
    depth = max(1, (width - 1).bit_length())
    size = 1 << depth
    tree = np.full((many, 2 * size), _NONE, np.int64)
    place = np.arange(width - 1)
    pair = place[None, :] + 1 < n[:, None]
    tree[:, size : size + width - 1] = np.where(pair, ranks.leaves(symbols[:, :-1], symbols[:, 1:], place[None, :], depth), _NONE)
    for level in range(depth - 1, -1, -1):
        lo = 1 << level
        tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
    after = np.tile(np.arange(1, width + 1), (many, 1))
    before = np.tile(np.arange(-1, width - 1), (many, 1))
    tree, sym, after, before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    rows = np.arange(many)
    while True:
        top = tree[rows * (2 * size) + 1]
        live = top != _NONE
        if not live.any():
            return symbols
        rows, top = rows[live], top[live]
        at, root = rows * width, rows * (2 * size)
        i = top & (size - 1)
        new = ranks.merged[top >> depth]
        j = after[at + i]
        k = after[at + j]
        after[at + i], sym[at + i], sym[at + j] = k, new, -1
        on = k < n[rows]
        before[(at + k)[on]] = i[on]
        right = np.where(on, ranks.leaves(new, sym[at + np.minimum(k, width - 1)], i, depth), _NONE)
        h = before[at + i]
        up = h >= 0
        left = ranks.leaves(sym[(at + h)[up]], new[up], h[up], depth)
        tree[root + size + j], tree[root + size + i], tree[(root + size + h)[up]] = _NONE, right, left
        base, x = np.concatenate([root, root, root[up]]), np.concatenate([j, i, h[up]]) + size
        for _ in range(depth):
            x = x >> 1
            kids = base + 2 * x
            tree[base + x] = np.minimum(tree[kids], tree[kids + 1])


class Numbered:
    """Strings with their ids: the ids in a row and where each string's end; forgotten as a whole."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.numbers)
        end = int(self.ends[known])
        self.ids, self.ends = _room(self.ids, end + len(ids)), _room(self.ends, known + 1 + len(sizes))
        self.ids[end : end + len(ids)] = ids
        self.ends[known + 1 : known + 1 + len(sizes)] = end + np.cumsum(sizes)
        self.numbers.update(zip(names, range(known, known + len(sizes))))

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these strings in a row, and how many each has."""
        n = self.ends[numbers + 1] - self.ends[numbers]
        take = np.repeat(self.ends[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[take], n

    def full(self, more: int, most: int) -> bool:
        return len(self.numbers) + more > most or self.ends[len(self.numbers)] > CACHE_IDS


class Coder:
    """Encodes and decodes with one vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path))
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("only byte-level BPE vocabularies without fallbacks are merged here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and spec["normalizer"] for t in added):
            raise ValueError("special tokens with side conditions are not supported")
        self.byte_decoder = (spec["decoder"] or {}).get("type") == "ByteLevel"
        if spec["decoder"] and not self.byte_decoder:
            raise ValueError("only byte-level decoders are supported")
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        kind = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        pattern = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.plain = (spec["normalizer"] or {}).get("normalizers") == PLAIN_NORMALIZER and kind == ["Split", "ByteLevel"] and pattern == PLAIN_PATTERN and not any(c.isspace() for t in added for c in t["content"])
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.letter_ids, self.last_ids = np.full(512, -1, np.int64), np.full(512, -1, np.int64)
        for c in letters:
            self.letter_ids[ord(c)], self.last_ids[ord(c)] = vocab.get(c, -1), vocab.get(c + suffix, -1)
        self.controls = {b: c for b, c in enumerate(letters) if b != ord(c) and b < 0x80 and b != 0x0A}
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] * _STEP + vocab[right]] = rank
            self.merged.append(vocab[left + right])
        self.table = Ranks(self.ranks, self.merged)
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.names = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = name
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        self.words, self.chunks = Numbered(), Numbered()

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in the byte alphabet in a row, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        first = np.cumsum(sizes) - sizes
        flat = self.letter_ids[letters]
        flat[first + sizes - 1] = self.last_ids[letters[first + sizes - 1]]
        if (flat < 0).any():  # letters that the vocabulary lacks
            sizes = np.add.reduceat((flat >= 0).astype(np.int64), first)
            flat = flat[flat >= 0]
            first = np.cumsum(sizes) - sizes
        done = flat.copy()
        for width in [*(1 << np.arange(1, FOREST.bit_length())), None]:
            if width is None:
                for w in np.flatnonzero(sizes > FOREST):
                    ids = merge(flat[first[w] : first[w] + sizes[w]].tolist(), self.ranks, self.merged)
                    done[first[w] : first[w] + sizes[w]] = ids + [-1] * (int(sizes[w]) - len(ids))
                continue
            some = np.flatnonzero((sizes <= width) & (sizes > width // 2) & (sizes > 1))
            if len(some):
                inside = np.arange(width) < sizes[some][:, None]
                at = (first[some][:, None] + np.arange(width))[inside]
                rows = np.full((len(some), width), -1, np.int64)
                rows[inside] = flat[at]
                done[at] = merge_forest(rows, sizes[some], self.table)[inside]
        ends = np.concatenate([[0], np.cumsum(done >= 0)])
        return done[done >= 0].astype(np.int32), ends[first + sizes] - ends[first]

    def _of_words(self, words: list[str], owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of ``many`` texts in a row, and how many each text has."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if self.words.full(len(names), CACHE_WORDS):
            self.words = Numbered()
        fresh = [w for w in names if w not in self.words.numbers]
        if fresh:
            self.words.add(fresh, *self._merged(fresh))
        number = np.fromiter(map(self.words.numbers.__getitem__, names), np.int64, len(names))
        ids, n = self.words.ids_of(number[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, np.bincount(owner, n, many).astype(np.int64)

    def _pieces(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text with special strings, or one that is not chunked."""
        out = [np.zeros(0, np.int32)]
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(np.array([self.special[piece]], np.int32))
            elif piece:
                whole = self.normalizer.normalize_str(piece) if self.normalizer else piece
                words = [w for w, _ in self.cutter.pre_tokenize_str(whole)]
                out.append(self._of_words(words, np.zeros(len(words), np.int64), 1)[0])
        return np.concatenate(out)

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks without ASCII white space, in a row, and how many each has."""
        kind = [0 if c.isascii() else 2 if _WHITE.search(c) else 1 for c in chunks]
        if self.special:
            kind = [2 if "<" in c and self.cut.search(c) else k for c, k in zip(chunks, kind)]
        kind = np.array(kind)
        lengths, parts = np.zeros(len(chunks), np.int64), [np.zeros(0, np.int32)]
        order = [np.zeros(0, np.int64)]
        for k in (0, 1):
            at = np.flatnonzero(kind == k)
            if not len(at):
                continue
            joined = "\n".join(map(chunks.__getitem__, at))
            if k == 0:
                joined = joined.lower()
                words = ASCII_WORD.findall(joined.translate(self.controls) if _CONTROL.search(joined) else joined)
                ends = np.fromiter((w == "\n" for w in words), bool, len(words))
                owner = np.cumsum(ends)[~ends]
                words = [w for w in words if w != "\n"]
            else:  # chunks have no white space of their own, so each blank is an end
                whole = self.normalizer.normalize_str(joined)
                found = self.cutter.pre_tokenize_str(whole)
                words = [w for w, _ in found]
                blanks = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le"), "<u4") == 0x20)
                owner = np.searchsorted(blanks, np.fromiter((s for _, (s, _) in found), np.int64, len(found)))
            ids, n = self._of_words(words, owner, len(at))
            lengths[at] = n
            parts.append(ids)
            order.append(at)
        for i in np.flatnonzero(kind == 2):
            parts.append(self._pieces(chunks[i]))
            lengths[i] = len(parts[-1])
            order.append(np.array([i]))
        # Back from the order of kinds to that of the chunks.
        order, flat = np.concatenate(order), np.concatenate(parts)
        start = np.zeros(len(chunks), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        take = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return flat[take], lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text; null is empty."""
        texts = texts.fill_null("")
        if not self.plain:
            found = [self._pieces(t) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(f) for f in found], np.int64)
        parts = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if self.chunks.full(len(names), CACHE_CHUNKS):
            self.chunks = Numbered()
        fresh = [n for n in names if n not in self.chunks.numbers]
        if fresh:
            self.chunks.add(fresh, *self._of_chunks(fresh))
        number = np.fromiter(map(self.chunks.numbers.__getitem__, names), np.int64, len(names))[codes]
        ids, n = self.chunks.ids_of(number)
        return ids, np.bincount(np.repeat(np.arange(len(texts)), counts), n, len(texts)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        tokens = [t for t in map(self.names.__getitem__, ids) if t is not None]
        if not self.byte_decoder:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            raw = [self.bytes_of.get(c) for c in t]
            out += t.encode() if None in raw else bytes(raw)
        return out.decode(errors="replace")


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), array.dtype)])


def coder(path: str) -> Coder:
    """One coder per worker process and vocabulary; it goes with the encoders of other operators."""
    stash = sys.modules.setdefault("_ledgerlake_encoders", SimpleNamespace(by_path={}))
    if ("bpe", path) not in stash.by_path:
        stash.by_path["bpe", path] = Coder(path)
    return stash.by_path["bpe", path]


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for whole in batches:
            for batch in slices(whole, 0, SLICE_BYTES):
                ids, lengths = code.encode(batch.column(0))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                flat = ids.tolist()
                decoded = [code.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lengths), lists, pa.array(decoded, pa.string())], ["rest", "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids and decoded (the ids' text); without the text where it is not asked for."""
    base = docs.select(F.col(f"`{text_col}`").alias("text"), carried(docs, *(() if with_text else (text_col,))).alias("rest"))
    coded = base.mapInArrow(lean(_coded(tokenizer_path), tokens=True), f"rest {base.schema['rest'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")
    return restored(coded, [c for c in docs.columns if with_text or c != text_col], {c: F.col(c) for c in ("n_tokens", "ids", "decoded")})
