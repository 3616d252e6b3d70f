"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton finds all vocabulary tokens in a word. The longest match is taken at each position if it is
compatible with the token before it; where no token fits, the last one gives way to a shorter one, and a position that
proved a dead end is not tried again. Two tokens are compatible if no merge across their border would have come before
the merges that made them: the border's left parts of one and right parts of the other are compared by rank.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import pieces as pc
from tallyforge.llm import textvec as tv
from tallyforge.llm.shared import table

_FOREVER = 1 << 62


def _byte_chars() -> list[str]:
    """The character that stands for each byte in vocabulary files: printable ones for themselves, others from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Exact merges of one vocabulary file whose words end in a suffix."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        byte = {c: b for b, c in enumerate(_byte_chars())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}

        def symbols(token: str) -> str:
            last = token.endswith(suffix)
            body = [byte[c] for c in (token.removesuffix(suffix) if last else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * last)

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            x, y, made = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[x, y] = r
            self.parts.setdefault(made, (x, y, r))
        self.words = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for token, i in self.vocab.items():
            if token not in self.special:
                s = symbols(token)
                self.size[i] = len(s)
                if len(s) == 1 or i in self.parts:
                    self.words.add_word(s, i)
        self.words.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        strings = [""] * (1 + max(max(self.vocab.values()), max(self.special.values(), default=0)))
        for token, i in [*self.vocab.items(), *self.special.items()]:
            strings[i] = token
        self.strings = OffsetTable([s + " " for s in strings])
        self.decimals = OffsetTable([f"{i} " for i in range(len(strings))])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token at one border, each with the rank of the merge that takes it up."""
        found, until = [(token, _FOREVER)], _FOREVER
        while token in self.parts:
            until = self.parts[token][2]
            token = self.parts[token][side]
            found.append((token, until))
        return found

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 600_000:
                self.fits.clear()
            right = self._edge(b, 0)
            known = not any(self.rank.get((x, y), _FOREVER) < until_x and self.rank.get((x, y), _FOREVER) <= until_y and (x, y) in self.rank for x, until_x in self._edge(a, 1) for y, until_y in right)
            self.fits[a, b] = known
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of one word as cut from the normalized text."""
        return self.encode_bytes(word.encode("utf-8", "replace"))

    def encode_bytes(self, raw: bytes) -> list[int]:
        text = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        n = len(text)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.words.iter(text):
            at[end + 1 - self.size[token]].append(token)
        whole = at[0][-1]
        if self.size[whole] == n:
            return [whole]
        dead = bytearray(n + 1)
        chosen: list[int] = []
        pos, k = 0, len(at[0]) - 1
        while pos < n:
            while k >= 0:
                token = at[pos][k]
                if not dead[pos + self.size[token]] and (not chosen or self.compatible(chosen[-1], token)):
                    break
                k -= 1
            if k >= 0:
                chosen.append(token)
                pos += self.size[token]
                k = len(at[pos]) - 1 if pos < n else 0
            else:
                dead[pos] = 1
                last = chosen.pop()
                pos -= self.size[last]
                k = at[pos].index(last) - 1
        return chosen


class OffsetTable:
    """Strings of all ids in one byte array: decoding is a gather, with no step for each token."""

    def __init__(self, strings: list[str]) -> None:
        raw = [s.encode() for s in strings]
        self.lens = np.fromiter(map(len, raw), np.int64, len(raw))
        self.off = np.cumsum(self.lens) - self.lens
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """For each run of counts ids the bytes of their strings in a row, without the last separator."""
        lens = self.lens[ids]
        out = self.data[pc.gather(self.off[ids], lens)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])]
        return [out[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_KNOWN: dict[str, tuple] = {}


def _encoder(path: str) -> tuple:
    """The encoder, its table of words, and the way for texts of unknown characters; one for each Python worker."""
    if path not in _KNOWN:
        own = WordEncoder(path)
        _KNOWN[path] = own, pc.PieceTable(lambda words: [own.encode(w) for w in words]), _whole(own, path)
    return _KNOWN[path]


def _whole(own: WordEncoder, path: str):
    """Ids of a text in which the library's newer Unicode tables are needed to cut words."""

    byte = {c: b for b, c in enumerate(_byte_chars())}
    lib: list = []

    def encode_text(text: str) -> list[int]:
        if not lib:
            from tokenizers import Tokenizer

            lib.append(Tokenizer.from_file(path))
        words = lib[0].pre_tokenizer.pre_tokenize_str(lib[0].normalizer.normalize_str(text))
        return [i for word, _ in words for i in own.encode_bytes(bytes(byte[c] for c in word))]

    return encode_text


def _normal(text: str | None) -> str | None:
    """NFC in lower case, each character for itself (a final sigma is like any other)."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower() if text else text


def encode(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row (null: none) and the number of ids of each."""
    own, known, whole = _encoder(path)
    return pc.ids_of(texts, pc.bare_pieces, known, own.special, whole, _normal)


def decode(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    """Texts of runs of ids."""
    return [b.decode() for b in _encoder(path)[0].strings.join(ids, counts)]


def _digests(path: str):
    sha = lambda raws: pa.array([hashlib.sha256(r).hexdigest() for r in raws])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(path)[0]
        for batch in batches:
            for a, b, texts in tv.parts(batch.column(1)):
                ids, counts = encode(texts, path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(counts.astype(np.int64)), sha(own.decimals.join(ids, counts)), sha(own.strings.join(ids, counts))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids array<int>): the ids themselves, one row in for one row out. Null text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in tv.parts(batch.column(1)):
                ids, counts = encode(texts, tokenizer)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def token_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row for each row. Null and empty texts have no tokens."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_backtracking(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
