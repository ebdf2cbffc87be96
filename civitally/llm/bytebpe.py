"""Byte-level BPE of a public vocabulary file: pieces, vocabulary, and the
per-prefix encoder.

The encoder stores, for every prefix of a piece, the one token that ends the
prefix's encoding. Candidates are the vocabulary entries that end there (one
pass of an Aho-Corasick automaton), and an entry is the right one when it can
follow the last token of the shorter prefix without any merge across their
border. Following the stored tokens back from the end gives the exact ids.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

#: Latin-1 members of the Unicode classes letter, number and white space.
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\\t-\\r \x85\xa0"
LATIN_PIECE = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {
            i: bytes(alphabet[c] for c in token)
            for token, i in ids.items()
            if token not in self.special
        }
        self.bytes |= {i: text.encode() for text, i in self.special.items()}
        #: (left id, right id) -> (rank, merged id), and the pair behind each id
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            one = (ids[left], ids[right])
            merged = ids[left + right]
            self.merge[one] = (rank, merged)
            self.parts.setdefault(merged, (rank, *one))
        self.split_special = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.vocab_path = path

    @functools.cached_property
    def pre_tokenizer(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    def segments(self, text: str) -> list[str]:
        """Texts between the special tokens, and these tokens."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return [part for part in self.split_special.split(text) if part]

    def pieces(self, text: str) -> list[str]:
        """The pieces that merges do not cross. The pattern above lists Latin-1
        only; other texts go through the library's own splitter."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return LATIN_PIECE.findall(text)

    # ---- borders ----------------------------------------------------------

    def right_edge(self, token: int) -> list[tuple[int, int]]:
        """Tokens that stand at the right end while ``token`` is built, each
        with the rank of the merge that ends it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, _, token = self.parts[token]

    def left_edge(self, token: int) -> list[tuple[int, int]]:
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, token, _ = self.parts[token]

    def crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge over the border of two tokens comes before ``before``
        and before both of its sides are merged away. Of equal ranks the left
        one goes first."""
        ends = self.left_edge(right)
        for x, x_until in self.right_edge(left):
            for y, y_until in ends:
                rank = self.merge.get((x, y), (NEVER, 0))[0]
                if rank < x_until and rank <= y_until and rank < before:
                    return True
        return False

    @functools.cached_property
    def whole(self) -> set[int]:
        """Tokens whose own text is encoded as that one token."""
        good: set[int] = set()
        for token in sorted(self.bytes, key=lambda t: self.parts.get(t, (-1,))[0]):
            if token in self.special.values():
                continue
            if token not in self.parts:
                if len(self.bytes[token]) == 1:
                    good.add(token)
                continue
            rank, left, right = self.parts[token]
            if left in good and right in good and not self.crossed(left, right, rank):
                good.add(token)
        return good


class PrefixEncoder:
    """Exact ids of a piece by the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token in vocabulary.whole:
            raw = vocabulary.bytes[token]
            self.automaton.add_word(raw.decode("latin-1"), (token, len(raw)))
        self.automaton.make_automaton()
        self.follows: dict[tuple[int, int], bool] = {}

    def can_follow(self, left: int, right: int) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) >= 2_000_000:
                self.follows.clear()
            known = self.follows[left, right] = not self.v.crossed(left, right)
        return known

    def __call__(self, piece: str) -> list[int]:
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last = [-1] * (len(text) + 1)
        start_of = [0] * (len(text) + 1)
        follows = self.follows
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            if start:
                before = last[start]
                fits = follows.get((before, token))
                if fits is None:
                    fits = self.can_follow(before, token)
                if not fits:
                    continue
            last[end], start_of[end] = token, start
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = start_of[at]
        return out[::-1]


class RankEncoder:
    """The same ids by the public rank table: for operators that only need ids."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        ranks = {
            raw: i for i, raw in vocabulary.bytes.items()
            if i not in vocabulary.special.values()
        }
        self.core = tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )

    def __call__(self, piece: str) -> list[int]:
        return self.core._encode_single_piece(piece)


class PieceCache(dict):
    """Piece -> ids as little-endian unsigned 32-bit integers; of bounded size."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = array("I", self.encode(piece)).tobytes()
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, vocabulary: Vocabulary, encode, cache_entries: int = 400_000):
        self.v = vocabulary
        self.cache = PieceCache(encode, cache_entries)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as packed little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self.v.segments(text):
            if part in self.v.special:
                out.append(array("I", [self.v.special[part]]).tobytes())
            else:
                out.append(b"".join(map(self.cache.__getitem__, self.v.pieces(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        ids = array("I")
        ids.frombytes(packed)
        raw = b"".join(map(self.v.bytes.__getitem__, ids))
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode("utf-8")
        return raw


def vocabulary_path(path: str | None) -> str:
    """A vocabulary file; None is the installed public 50k byte vocabulary."""
    if path is None:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    return path


@functools.lru_cache(maxsize=4)
def vocabulary(path: str | None) -> Vocabulary:
    return Vocabulary(vocabulary_path(path))


@functools.lru_cache(maxsize=4)
def prefix_codec(path: str | None = None) -> Codec:
    """One codec per Python worker, kept between its tasks."""
    return Codec(vocabulary(path), PrefixEncoder(vocabulary(path)))


@functools.lru_cache(maxsize=4)
def rank_codec(path: str | None = None) -> Codec:
    return Codec(vocabulary(path), RankEncoder(vocabulary(path)), 200_000)
