"""Encoding of a corpus with a public byte-pair tokenizer, by traversal of a prefix trie.

The byte-pair encoding of a word's prefix is fixed by its last token: the encoding of a prefix
is that of the shorter prefix without its last token, then that token. The last token is the
one token that ends the prefix and can stand after the last token of what remains, i.e. the
pair, encoded on its own, stays two tokens. So one state per trie node, the last token, holds
the encoding of the whole prefix. The distinct words of a batch are visited in byte order, which is the
depth-first order of their trie; a shared prefix is computed once.

Words never cross documents, so every task encodes its own rows and nothing is shuffled.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroot.work import ship

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The word pattern that the byte-level vocabularies were published with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pairs of tokens, remembered from batch to batch within a task; then the memory starts anew.
MEMORY = 400_000


class TrieEncoder:
    """Byte-pair encoding with the ranks of a published vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # Which lengths tokens with the same two last bytes have, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                lengths.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {tail: tuple(sorted(found, reverse=True)) for tail, found in lengths.items()}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.words = regex.compile(PATTERN).findall

    def _merge(self, word: bytes) -> list[int]:
        """Plain byte-pair merging of a short word: the lowest-ranked pair first."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            at, best = -1, None
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    at, best = i, r
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _follows(self, a: int, b: int) -> bool:
        """Whether the tokens a, b stay as they are when their bytes are encoded together."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            got = self.fits[a, b] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """The tokens of each word, computed along the trie of the words."""
        ranks, lengths, follows = self.ranks, self.lengths, self._follows
        out: dict[str, list[int]] = {}
        path = b""
        last: list[int] = []  # last[i]: the last token of path[: i + 1]
        from_: list[int] = []  # where that token begins
        for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = os.path.commonprefix([path, raw])
            depth = len(shared)
            del last[depth:], from_[depth:]
            for end in range(depth + 1, len(raw) + 1):
                # Longer tokens first; only one can be right, the single byte if no other.
                for size in lengths.get(raw[end - 2 : end], ()) if end > 1 else ():
                    begin = end - size
                    if begin >= 0:
                        token = ranks.get(raw[begin:end])
                        if token is not None and (begin == 0 or follows(last[begin - 1], token)):
                            break
                else:
                    begin, token = end - 1, ranks[raw[end - 1 : end]]
                last.append(token)
                from_.append(begin)
            path = raw
            tokens, i = [], len(raw)
            while i:
                tokens.append(last[i - 1])
                i = from_[i - 1]
            out[word] = tokens[::-1]
        return out

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; none for null and empty ones."""
        split = [self.words(t) if isinstance(t, str) else [] for t in texts]
        known = self.known
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = {w for words in split for w in words}
        known.update(self.encode_words(list(new)))
        return [[i for w in words for i in known[w]] for words in split]


_loaded: dict[str, TrieEncoder] = {}
_sent: set[tuple[str, str]] = set()


def encoder(path: str) -> TrieEncoder:
    """The encoder of a vocabulary file, one per process; on an executor the file is the copy it was sent."""
    if path not in _loaded:
        sent = SparkFiles.get(os.path.basename(path)) if TaskContext.get() else path
        _loaded[path] = TrieEncoder(sent if os.path.exists(sent) else path)
    return _loaded[path]


def send(docs: DataFrame, path: str) -> None:
    """Sends the vocabulary file from the driver to the executors, once per application."""
    context = docs.sparkSession.sparkContext
    if (context.applicationId, path) not in _sent:
        context.addFile(path)
        _sent.add((context.applicationId, path))


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


def encode_column(docs: DataFrame, text: str, out: str, path: str, only_counts: bool = False) -> DataFrame:
    """docs without `text` and with `out`: its ids (array of int), or their number (long).

    Null and empty texts have no ids. Special tokens' strings are ordinary text. All other
    columns are passed through; a column named `out` is replaced.
    """
    ship(docs.sparkSession)
    send(docs, path)
    docs = docs.drop(*([out] if out in docs.columns and out != text else []))
    kind = "bigint" if only_counts else "array<int>"
    rest = [c for c in docs.columns if c != text]

    @F.pandas_udf(kind)
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for part in parts:
            got = enc.encode_texts(part.tolist())
            yield pd.Series([len(x) for x in got] if only_counts else got, dtype="int64" if only_counts else object)

    return docs.select(*rest, ids(F.col(text)).alias(out))
