"""Subword token ids (M10): longest match over a piece vocabulary, padded, with a mask.

A text is cut at white space and around punctuation; each word is matched from the left
by the longest piece of the vocabulary, the rest by the longest continuation piece, and so
on. A word that can't be matched to its end, or is longer than ``MAX_WORD`` characters, is the unknown piece.
``[CLS] pieces [SEP]`` is cut to ``length`` ids and padded; the mask is 1 on real ids.

The vocabulary is a table (piece, id) whose continuation pieces begin with ``##``. It is
a fixed input, read from its public file and never trained here; its size is bounded
by ``MAX_PIECES``, so it goes to the workers as one broadcast variable. Workers build the two tries once.
Each Arrow batch looks up its distinct words only.
"""

from __future__ import annotations

import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

MAX_TOKENS = 128
MAX_WORD = 100
MAX_PIECES = 1_000_000
CONTINUES = "##"
CLS, SEP, PAD, UNKNOWN = "[CLS]", "[SEP]", "[PAD]", "[UNK]"
SPECIAL = (PAD, UNKNOWN, CLS, SEP)

SCHEMA = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)),
                       T.StructField("attention_mask", T.ArrayType(T.IntegerType(), False)),
                       T.StructField("n_pieces", T.IntegerType())])


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id) of a text file with one piece a line; the id is the line's number. The file is
    read as one value, so that the numbers follow its lines."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("id", "piece"))
    return lines.where("piece != ''").select("piece", "id")


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabulary files write for each byte: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pieces_of_byte_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id) from a byte-level vocabulary file: tokens with a space in front start words, the
    others continue them; tokens that aren't whole characters are left out, single
    characters start words, too. The special pieces get the ids behind the last one."""
    text = spark.read.text(path, wholetext=True).first()[0]
    vocab = json.loads(text)["model"]["vocab"]
    if len(vocab) > MAX_PIECES:
        raise ValueError(f"a vocabulary of {len(vocab)} pieces is no small table")
    of = byte_characters()
    out: dict[str, int] = {}
    for token, i in sorted(vocab.items(), key=lambda kv: kv[1]):
        try:
            s = bytes(of[c] for c in token).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        word = s[1:] if s.startswith(" ") else s
        if not word or word != "".join(word.split()):
            continue
        out.setdefault(word if s.startswith(" ") else CONTINUES + word, i)
        if len(s) == 1:
            out.setdefault(s, i)
    last = max(vocab.values(), default=-1)
    out |= {p: last + 1 + k for k, p in enumerate(SPECIAL)}
    return spark.createDataFrame(list(out.items()), "piece string, id int")


def is_punctuation(c: str) -> bool:
    """ASCII symbols and Unicode punctuation."""
    return 33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 or 91 <= ord(c) <= 96 or 123 <= ord(c) <= 126 \
        or unicodedata.category(c).startswith("P")


class Trie:
    """Pieces by their characters, one node a dict; the id of a piece lies under the empty key."""

    def __init__(self, pieces):
        self.root: dict = {}
        for piece, i in pieces:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i

    def longest(self, word: str, start: int) -> tuple[int, int]:
        """(end, id) of the longest piece at ``start``; (start, -1) if there is none."""
        node, best = self.root, (start, -1)
        for k in range(start, len(word)):
            node = node.get(word[k])
            if node is None:
                break
            if "" in node:
                best = k + 1, node[""]
        return best


class SubwordTokenizer:
    """Words to pieces; remembers the ids of words it has met, up to ``cache`` of them."""

    def __init__(self, vocabulary: dict[str, int], cache: int = 200_000):
        self.first = Trie((p, i) for p, i in vocabulary.items() if not p.startswith(CONTINUES) and p not in SPECIAL)
        self.next = Trie((p[len(CONTINUES):], i) for p, i in vocabulary.items() if p.startswith(CONTINUES))
        self.cls, self.sep, self.pad, self.unknown = (vocabulary[p] for p in (CLS, SEP, PAD, UNKNOWN))
        self.cache, self.known = cache, {}

    def words(self, chunk: str) -> list[str]:
        """A chunk without white space, cut around punctuation; control characters go."""
        if chunk.isalnum():
            return [chunk]
        out, held = [], []
        for c in chunk:
            if is_punctuation(c):
                out += ["".join(held), c] if held else [c]
                held = []
            elif not unicodedata.category(c).startswith("C"):
                held.append(c)
        return out + ["".join(held)] if held else out

    def pieces(self, word: str) -> list[int]:
        if len(word) > MAX_WORD:
            return [self.unknown]
        out, at, trie = [], 0, self.first
        while at < len(word):
            at, i = trie.longest(word, at)
            if i < 0:
                return [self.unknown]
            out.append(i)
            trie = self.next
        return out

    def chunk(self, chunk: str) -> list[int]:
        got = self.known.get(chunk)
        if got is None:
            got = [i for w in self.words(chunk) for i in self.pieces(w)]
            if len(self.known) >= self.cache:
                self.known.clear()
            self.known[chunk] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of the whole text, without special pieces."""
        return [i for c in (text or "").split() for i in self.chunk(c)]

    def padded(self, text: str | None, length: int) -> tuple[list[int], list[int], int]:
        ids = self.encode(text)
        row = [self.cls, *ids[:max(0, length - 2)], self.sep][:length]
        return row + [self.pad] * (length - len(row)), [1] * len(row) + [0] * (length - len(row)), len(ids)


_TOKENIZERS: dict = {}


def _tokenizer(shared) -> SubwordTokenizer:
    """One tokenizer a worker, of the vocabulary that it met last."""
    key, words = shared.value
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = SubwordTokenizer(words)
    return _TOKENIZERS[key]


def _share(vocabulary: DataFrame):
    rows = vocabulary.select("piece", "id").limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary of over {MAX_PIECES} pieces is no small table")
    words = {r.piece: r.id for r in rows if r.piece is not None}
    missing = [p for p in SPECIAL if p not in words]
    if missing:
        raise ValueError(f"the vocabulary lacks {missing}")
    return vocabulary.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, words))


def subword_tokens(df: DataFrame, vocabulary: DataFrame, text_col: str = "text", length: int = MAX_TOKENS) -> DataFrame:
    """``df`` with ``input_ids`` and ``attention_mask`` (``length`` ints each) and ``n_pieces``
    (pieces of the whole text, before the cut). Null and empty texts hold the two
    special ids alone. Columns of those names are replaced."""
    ship_package(df.sparkSession)
    shared = _share(vocabulary)

    @F.pandas_udf(SCHEMA)
    def tokens(texts: pd.Series) -> pd.DataFrame:
        t = _tokenizer(shared)
        return pd.DataFrame([t.padded(x, length) for x in texts], columns=SCHEMA.names)

    keep = [c for c in df.columns if c not in SCHEMA.names]
    out = df.select(*[F.col(f"`{c}`") for c in keep], tokens(F.col(text_col)).alias("_tokens"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "_tokens.*")


def real_tokens(mask: Column) -> Column:
    """Number of ids that aren't padding."""
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)
