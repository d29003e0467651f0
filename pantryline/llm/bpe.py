"""Byte-pair encoding of words by backtracking, and decoding through an offset table.

The encoder finds all vocabulary tokens in a word with an Aho-Corasick automaton, takes the
longest token at each place, and keeps it only if it is compatible with the token before it:
merging the two strings together must leave exactly that pair. Where no token fits it steps
back one token and takes a shorter one; a bit per position remembers dead ends, so every
position is left at most once. The result equals running all merges in rank order.

Results: a null text has no ids and decodes to the empty text, as an empty one does. Rows keep
their `doc_id`, null and repeated ones too; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantryline.llm.common import batches, relieve, small_batches, texts_of

VOCABULARY = "word_bpe_49k.json"
#: Entries held at most per worker: of the caches of words and of words with their punctuation, and
#: of the one of pairs. A full cache is emptied.
WORD_CACHE, PAIR_CACHE = 100_000, 300_000
#: A symbol that ends a word is the same character shifted by this much.
END = 0x8000

#: Texts of these characters only need no normal form, and their classes are the ones below.
#: Any other text is normalised and split by the tokenizer's own rules.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-į]*")
LETTERS, NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-į", "0-9²³¹¼-¾"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")


def vocabulary_path(name: str) -> str:
    """Where a vocabulary lies: a path is taken as it is, a bare name is one of the public files."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character standing for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self._rules = Tokenizer.from_file(path)
        self._bytes = byte_characters()
        ids: dict[str, int] = model["vocab"]

        # Ids of merged tokens ascend with their rank, which the compatibility check relies on.
        self.merged: dict[int, int] = {}
        self.left, self.right = {}, {}
        last = -1
        for a, b in model["merges"]:
            a_id, b_id, c_id = ids[a], ids[b], ids[a.removesuffix(self.suffix) + b]
            if c_id <= last:
                raise ValueError("merges must be listed in the order of their token ids")
            last = c_id
            self.merged[a_id << 32 | b_id] = c_id
            self.left[c_id], self.right[c_id] = a_id, b_id

        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self.lengths: dict[int, int] = {}
        self._tokens = ahocorasick.Automaton()
        for token, i in ids.items():
            key = self._symbols(token)
            self.lengths[i] = len(key)
            if self._reachable(i):
                self._tokens.add_word(key, i)
        self._tokens.make_automaton()

        # The offset table: every token followed by a space in one buffer, and where each starts.
        names = {i: t for t, i in [*ids.items(), *self.special.items()]}
        pieces = [(names[i] + " ").encode() if i in names else b"" for i in range(max(names) + 1)]
        self._starts = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self._buffer = np.frombuffer(b"".join(pieces), np.uint8)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            word = token.removesuffix(self.suffix)
            return word[:-1] + chr(ord(word[-1]) + END)
        return token

    def _reachable(self, token: int) -> bool:
        """Whether the token's own string is merged into it: nothing merges across its last seam before."""
        return token not in self.left or self._seam_holds(self.left[token], self.right[token], token)

    def _seam_holds(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank below `before` crosses the seam between tokens `a` and `b`.

        Both sides are taken apart along the seam, latest merge first. `limit` is the rank up to which
        the two pieces now at the seam lie next to each other.
        """
        limit = before
        while True:
            met = self.merged.get(a << 32 | b)
            if met is not None and met < limit:
                return False
            # Undo the later of the two merges; on equal ranks the one further right happened later.
            a_rank, b_rank = (a if a in self.left else -1), (b if b in self.left else -1)
            if a_rank < 0 and b_rank < 0:
                return True
            if a_rank > b_rank:
                limit, a = a_rank, self.right[a]
            else:
                limit, b = b_rank + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIR_CACHE:
                self._pairs.clear()
            known = self._pairs[key] = self._seam_holds(a, b, 1 << 40)
        return known

    def encode_symbols(self, word: str) -> list[int]:
        """Token ids of a word given as symbols, the last one shifted by END."""
        found: list[list[int]] = [[] for _ in word]
        lengths = self.lengths
        for end, token in self._tokens.iter(word):
            found[end + 1 - lengths[token]].append(token)  # shorter tokens are met first
        size, at = len(word), 0
        dead = bytearray(size + 1)
        out: list[int] = []
        tried = [len(f) for f in found]  # candidates of each place not yet tried
        while at < size:
            left, options = tried[at], found[at]
            while left:
                left -= 1
                token = options[left]
                if not dead[at + lengths[token]] and (not out or self.compatible(out[-1], token)):
                    break
            else:
                # Nothing fits here: step back, and never come to this place again.
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a symbol")
                at -= lengths[out.pop()]
                continue
            tried[at] = left
            out.append(token)
            at += lengths[token]
            if at < size:
                tried[at] = len(found[at])
        return out

    def _mapped(self, marks: str) -> bytes:
        return array("I", self.encode_symbols(marks[:-1] + chr(ord(marks[-1]) + END))).tobytes()

    def _word(self, word: str) -> bytes:
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= WORD_CACHE:
                self._words.clear()
            known = self._words[word] = self._mapped("".join([self._bytes[b] for b in word.encode()]))
        return known

    def _chunk(self, chunk: str) -> bytes:
        known = self._chunks.get(chunk)
        if known is None:
            if len(self._chunks) >= WORD_CACHE:
                self._chunks.clear()
            known = self._chunks[chunk] = b"".join([self._word(w) for w in WORDS.findall(chunk)])
        return known

    def _plain(self, text: str) -> bytes:
        """Words never span white space, so what lies between is looked up whole."""
        chunks, known = text.lower().split(), self._chunks
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            return b"".join([self._chunk(c) for c in chunks])

    def _ruled(self, text: str) -> bytes:
        """Text with characters outside PLAIN: the file's own normaliser and splitter, then our encoder."""
        normal = self._rules.normalizer.normalize_str(text)
        return b"".join([self._mapped(w) for w, _ in self._rules.pre_tokenizer.pre_tokenize_str(normal) if w])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens in the text are their own ids."""
        if not text:
            return b""
        out, at = [], 0
        for hit in self._special.finditer(text) if "<|" in text else ():
            out += [self._piece(text[at : hit.start()]), self.special[hit[0]].to_bytes(4, "little")]
            at = hit.end()
        return b"".join([*out, self._piece(text[at:])])

    def _piece(self, text: str) -> bytes:
        return self._plain(text) if PLAIN.fullmatch(text) else self._ruled(text)

    def forget(self) -> None:
        """Empty the caches."""
        for cache in (self._words, self._chunks, self._pairs):
            cache.clear()

    def decode(self, ids: bytes, chunk: int = 1 << 16) -> bytes:
        """The tokens' names in UTF-8, a space between them, as the file names no other decoder."""
        out = []
        for at in range(0, len(ids), 4 * chunk):
            some = np.frombuffer(ids[at : at + 4 * chunk], "<u4")
            starts = self._starts[some]
            sizes = self._starts[some + 1] - starts
            ends = np.cumsum(sizes)
            place = np.repeat(starts - (ends - sizes), sizes)
            place += np.arange(len(place))
            out.append(self._buffer[place].tobytes())
        return b"".join(out)[:-1]


@functools.cache
def word_bpe(name: str = VOCABULARY) -> WordBpe:
    """One encoder per worker process and file."""
    return WordBpe(vocabulary_path(name))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, ids (binary, unless `with_ids` is off), n_tokens, ids_sha256, decoded_sha256.

    A narrow pass over the table: no shuffle, one text at a time.
    """
    names = ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bpe = word_bpe(vocabulary)
        for part in parts:
            for doc_id, text in zip(texts_of(part, "doc_id"), part.column(1), strict=True):
                ids = bpe.encode(text.as_py())
                yield (
                    doc_id,
                    ids if with_ids else None,
                    len(ids) // 4,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(bpe.decode(ids)).hexdigest(),
                )
        bpe.forget()
        relieve()

    out = small_batches(docs).select("doc_id", "text").mapInArrow(
        lambda parts: batches(rows(parts), names, types, 256),
        "doc_id long, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
    return out if with_ids else out.drop("ids")
