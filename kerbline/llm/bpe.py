"""Byte-level BPE by trie traversal with last-token states, and decoding.

In a byte-level BPE whose tokens each encode to themselves, the encoding of
every prefix of a word ends in exactly one token, and that token is fixed by two
tests: it is a suffix of the prefix, and it may follow the last token of what
remains (merging would not have joined them otherwise).  So the last token is a
state of a trie node.  Distinct words go into a trie; a depth-first walk gives
each node its state from its ancestors' states, and what words share as a prefix
is computed once.  A word's ids follow by walking back from its node.

Null and empty texts encode to no ids.  Texts of any length are encoded whole.
Equal texts, repeated rows included, have equal ids; an empty table gives an empty
one.  Encoding and decoding are column functions, so no column's name matters.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, functions as F, types as T

from kerbline.llm.arrow import texts

#: Entries that a worker's memo keeps, of the trie walk and of the library's encoder.
MEMO, LIBRARY_MEMO = 280_000, 700_000

# Unicode's White_Space, and the pre-tokenizing pattern of byte-level BPE vocabularies of this kind.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files, inverted."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes; internally numbered so that a later merge has a larger number."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.joined: dict[int, int] = {}
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for left, right in merges:
            a, b = self.number[as_bytes(left)], self.number[as_bytes(right)]
            made = as_bytes(left + right)
            if made in self.number:
                raise ValueError(f"two merges make {made!r}")
            self.number[made] = self.joined[a << 20 | b] = len(self.split)
            self.split.append((a, b))
        self.length = [0] * len(self.split)
        self.id_of = [0] * len(self.split)
        self.bytes_of_id: dict[int, bytes] = {}
        for text, i in model["vocab"].items():
            raw = as_bytes(text)
            self.bytes_of_id[i] = raw
            if raw in self.number:
                self.id_of[self.number[raw]] = i
        for raw, k in self.number.items():
            self.length[k] = len(raw)
        self.longest = max(self.length)
        self.packed = [struct.pack("<I", i) for i in self.id_of]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of_id |= {i: t.encode() for t, i in self.special.items()}
        self._follows: dict[int, bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` then ``b`` as they are: no merge across the border comes before both are complete."""
        key = a << 20 | b
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) > 2 * MEMO:
                self._follows.clear()
            known = self._follows[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the latest merge on either side, step by step, and look for an earlier merge across the border.
        joined, split = self.joined, self.split
        bound = len(split)
        while True:
            across = joined.get(a << 20 | b)
            if across is not None and across < bound:
                return False
            if a > b:
                if a >= 256:
                    bound, a = a, split[a][1]
                else:
                    if b < 256:
                        return True
                    bound, b = b + 1, split[b][0]
            else:
                if b >= 256:
                    bound, b = b + 1, split[b][0]
                else:
                    if a < 256:
                        return True
                    bound, a = a, split[a][1]

    def walk(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, packed ids) for distinct words, in trie order.

        Sorted words are a depth-first order of their trie; ``state`` is the path
        from the root, kept where the next word shares it.
        """
        number, follows, length, packed, longest = self.number, self.follows, self.length, self.packed, self.longest
        state: list[int] = [-1]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = number.get(word[start:end])
                    if token is not None and (start == 0 or follows(state[start], token)):
                        state.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            out, at = [], len(word)
            while at:
                token = state[at]
                out.append(packed[token])
                at -= length[token]
            out.reverse()
            before = word
            yield word, b"".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class ChunkEncoder:
    """Encodes texts piece by piece through a memo that survives batches and, with worker reuse, tasks.

    A text is cut before each single space that no white space follows; no
    pre-token crosses such a cut, so a piece's ids do not depend on its
    neighbours.  Other texts are one piece.  ``encode_new(pieces)`` gives the
    packed ids of pieces not seen before.
    """

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], special: dict[str, int], most: int = MEMO):
        self.encode_new, self.most = encode_new, most
        self.memo: dict[str, bytes] = {}
        self.special = {t: struct.pack("<I", i) for t, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.runs = regex.compile(rf" [{SPACES}]")

    def _pieces(self, text: str) -> list[str]:
        if self.cut is not None and any(t in text for t in self.special):
            out: list[str] = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self._pieces(part) if part else []
            return out
        if self.runs.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]] if first else [" " + r for r in rest]

    def __call__(self, batch: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in batch]
        memo = self.memo
        new = set().union(*cut).difference(memo)
        new.difference_update(self.special)
        fresh = list(new)
        memo.update(self.special)
        memo.update(zip(fresh, self.encode_new(fresh), strict=True))
        get = memo.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        if len(memo) > self.most:  # the pieces seen first are the frequent ones; they stay
            for piece in fresh:
                del memo[piece]
        return out


@lru_cache(maxsize=4)
def trie_encoder(path: str) -> ChunkEncoder:
    """Pieces encoded by the trie walk over their distinct pre-tokens."""
    vocab, pattern = vocabulary(path), regex.compile(PIECES)

    def encode_new(pieces: list[str]) -> list[bytes]:
        cut = [[w.encode() for w in pattern.findall(p)] for p in pieces]
        ids = dict(vocab.walk(list(set().union(*cut))))
        return [b"".join(map(ids.__getitem__, words)) for words in cut]

    return ChunkEncoder(encode_new, vocab.special)


@lru_cache(maxsize=4)
def library_encoder(path: str) -> ChunkEncoder:
    """Pieces encoded by the tokenizers library itself."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    table = tokenizer.get_vocab(with_added_tokens=True)
    size = np.zeros(1 + max(table.values()), np.int64)
    for token, i in table.items():
        size[i] = len(token)  # a letter stands for a byte
    runs = regex.compile(rf" [{SPACES}]")

    def encode_new(pieces: list[str]) -> list[bytes]:
        # Pieces that begin with a space keep their ids side by side, so one call encodes thousands; the tokens' sizes tell them apart.
        out = dict.fromkeys(pieces, b"")
        side = [p for p in pieces if p[0] == " " and not runs.search(p)]
        for k in range(0, len(side), JOINED):
            part = side[k : k + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            raw, at = ids.tobytes(), 0
            for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                out[piece], at = raw[at:end], end
        own = [p for p in pieces if not out[p]]
        for piece, e in zip(own, tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
            out[piece] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return list(out.values())

    return ChunkEncoder(encode_new, special, LIBRARY_MEMO)


#: Pieces that one call of the library encodes.
JOINED = 4000
#: Texts encoded at a time, which bounds what a batch adds to a full memo.
SLICE = 500


def encode(path: str, library: bool = False) -> Callable[[Column], Column]:
    """A column function: text -> its ids as little-endian unsigned 32-bit integers in one binary."""

    @F.arrow_udf(T.BinaryType())
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = (library_encoder if library else trie_encoder)(path)
        for batch in batches:
            rows = texts(batch)
            out: list[bytes] = []
            for i in range(0, len(rows), SLICE):
                out += encoder(rows[i : i + SLICE])
            yield pa.array(out, pa.binary())

    return apply


def decode(path: str) -> Callable[[Column], Column]:
    """A column function: packed ids -> text, special tokens kept, malformed UTF-8 replaced; null for null."""

    @F.arrow_udf(T.StringType())
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = vocabulary(path).bytes_of_id
        for batch in batches:
            out = [
                None if b is None else b"".join([table.get(i, b"") for i in memoryview(b).cast("I")]).decode("utf-8", "replace")
                for b in batch.to_pylist()
            ]
            yield pa.array(out, pa.string())

    return apply


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
