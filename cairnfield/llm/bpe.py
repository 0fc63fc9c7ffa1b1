"""BPE encoding and decoding with a contiguous rank array (operator 2), and the encoder that operators 1 and 9 use.

`encode` adds an `ids` column to a table of texts, `decode` turns ids into text. Both run over Arrow batches; a worker
keeps what it has encoded in a bounded table of pieces, so that memory does not follow the number of distinct words.
"""

from __future__ import annotations

import gc
import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices

#: How byte-level BPE cuts a text into words: fixed by the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps, about 75 MB; at the limit it starts anew.
KEPT_PIECES = 500_000
#: Longer words go to a heap, because scanning an array for its minimum is quadratic.
SHORT_WORD = 128
_NONE = 1 << 60


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def merge_short(word: bytes, byte_id: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of a word. `bounds` holds where parts begin, `ranks` the rank of each boundary between neighbours: the least goes first."""
    parts = [byte_id[b] for b in word]
    bounds = list(range(len(word)))
    get, none = pairs.get, (_NONE, 0)
    found = [get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
    ranks = [r for r, _ in found]
    while ranks:
        least = min(ranks)
        if least == _NONE:
            break
        i = ranks.index(least)
        parts[i] = get(parts[i] << 20 | parts[i + 1])[1]
        del bounds[i + 1], parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(parts[i] << 20 | parts[i + 1], none)[0]
        if i:
            ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], none)[0]
    return parts


def merge_long(word: bytes, byte_id: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The same ids for a long word, with linked parts and a heap of boundaries in place of the scan."""
    from heapq import heapify, heappop, heappush

    parts = [byte_id[b] for b in word]
    n, get = len(parts), pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(hit[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (hit := get(parts[i] << 20 | parts[i + 1]))]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if j >= n or parts[i] != left or parts[j] != right:
            continue
        parts[i], parts[j] = get(left << 20 | right)[1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (hit := get(parts[a] << 20 | parts[b])):
                heappush(heap, (hit[0], a, parts[a], parts[b]))
    return [p for p in parts if p >= 0]


class Pieces(dict):
    """Ids, packed as bytes, of a stretch of text that no word crosses; fills itself and stays bounded."""

    def __init__(self, words: Callable[[str], list[str]], word: Callable[[str], bytes], limit: int):
        super().__init__()
        self.words, self.word, self.limit = words, word, limit

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        words = self.words(stretch)
        packed = self.word(stretch) if len(words) < 2 else b"".join([self[w] for w in words])
        if len(stretch) <= 64:
            self[stretch] = packed
        return packed


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library. `own`: merge with our rank array, else with the library's model."""

    def __init__(self, path: str, own: bool = True, limit: int = KEPT_PIECES):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        if own:
            byte_id = [vocab[c] for c in letters]
            pairs = {}
            for rank, m in enumerate(spec["model"]["merges"]):
                a, b = m if isinstance(m, list) else m.split(" ")
                pairs[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
            word = lambda w: (merge_short if len(raw := w.encode()) <= SHORT_WORD else merge_long)(raw, byte_id, pairs)
        else:
            from tokenizers import Tokenizer

            tokenize = Tokenizer.from_file(path).model.tokenize
            plain, space = re.compile(r"[ -~]*").fullmatch, letters[32]
            word = lambda w: [t.id for t in tokenize(w.replace(" ", space) if plain(w) else "".join([letters[b] for b in w.encode()]))]
        code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = Pieces(regex.compile(WORDS).findall, lambda w: array(code, word(w)).tobytes(), limit)
        self._odd = re.compile(r"\s\s|[\x00\x1c-\x1f]").search
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def packed(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned integers of `dtype`. A special token's string in the text is that token."""
        if self.split and any(s in text for s in self.special):
            return b"".join([np.array([self.special[p]], self.dtype).tobytes() if p in self.special else self._plain(p) for p in self.split(text)])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd(text):
            stretches = self.pieces.words(text)
        else:  # between characters that are no white space, a word begins before each space, and a line's end is a word
            stretches = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.pieces.__getitem__, stretches))

    def odd(self, text: str) -> bool:
        """Whether white space meets white space, or a control character is there. Where all but the lines' ends is printable,
        space is the only other white space, which spares the search."""
        if text.replace("\n", "").isprintable():
            return "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        return self._odd(text) is not None

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)


class Decoder:
    """The bytes of every id of a vocabulary file; no merges are read."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.numerals = [str(i) for i in range(len(self.bytes_of))]

    def text(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def decoder(path: str | None) -> Decoder:
    return Decoder(path or default_vocab())


@lru_cache(maxsize=2)
def encoder(path: str | None, own: bool) -> ByteBPE:
    """The worker's encoder: read once for a process."""
    return ByteBPE(path or default_vocab(), own)


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str | None, own: bool, end: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.dtype]]:
    """Slices of the batches (key columns, text last), a few MB at a time, with the packed ids of their texts; null texts are empty."""
    bpe = encoder(path, own)
    tail = b"" if end is None else np.array([end], bpe.dtype).tobytes()
    for rows in slices(batches):
        # Encoding makes many small objects and no cycles; looking for cycles meanwhile costs a tenth of the time.
        looks = gc.isenabled()
        gc.disable()
        try:
            packed = [bpe.packed(t.as_py() or "") + tail for t in rows.column(rows.num_columns - 1)]
        finally:
            if looks:
                gc.enable()
        yield rows, packed, bpe.dtype


def id_lists(packed: list[bytes], dtype: np.dtype) -> pa.ListArray:
    """Packed ids as an Arrow list column."""
    ends = np.cumsum([0, *(len(p) // dtype.itemsize for p in packed)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype).astype("int32")))


def encode(df: DataFrame, key: list[str], text: str = "text", vocab: str | None = None, own: bool = True, end: int | None = None) -> DataFrame:
    """`key` columns and `ids array<int>` of every whole text; `end`, if given, is appended to each document's ids.

    A null or empty text has no ids (but for `end`). Repeated rows stay repeated; an empty table gives an empty one. Other
    columns are left out, so none can clash with `ids`. `vocab` is the path of a byte-level vocabulary file.
    """
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        for rows, packed, dtype in encoded_batches(batches, vocab, own, end):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], id_lists(packed, dtype)], [*key, "ids"])

    return df.select(*key, F.col(text)).mapInArrow(run, schema)


def decode(df: DataFrame, key: list[str], ids: str = "ids", vocab: str | None = None) -> DataFrame:
    """`key` columns, `ids`, and the `text` that they stand for.

    Null or no ids give the empty text; an id outside the vocabulary raises. Repeated rows stay repeated, an empty table gives
    an empty one, other columns are left out.
    """
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def run(batches):
        known = decoder(vocab)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                texts = [known.text(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in part.column(len(key))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*key, "ids", "text"])

    return df.select(*key, F.col(ids)).mapInArrow(run, schema)


#: What `round_trip` can return, and the types.
OUTPUTS = {
    "ids": (T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "n_tokens": (T.LongType(), pa.int64()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def round_trip(df: DataFrame, key: list[str], text: str = "text", vocab: str | None = None, columns: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """`key` columns and the named `columns` of OUTPUTS: every whole text encoded, and its ids decoded, in one pass and one worker.

    Digests are of the decimal ids joined by commas and of the decoded text's UTF-8. A null text counts as the empty one, which
    has no ids. Repeated rows stay repeated, an empty table gives an empty one, columns not in `key` are left out.
    """
    schema = T.StructType([*(df.schema[k] for k in key), *(T.StructField(c, OUTPUTS[c][0]) for c in columns)])
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches):
        known = decoder(vocab)
        numeral = known.numerals.__getitem__
        for rows, packed, dtype in encoded_batches(batches, vocab, True):
            found: dict[str, list] = {c: [] for c in columns}
            for p in packed:
                own = np.frombuffer(p, dtype).tolist()
                decoded = known.text(own) if {"decoded", "decoded_sha256"} & found.keys() else None
                values = {"ids": lambda: own, "decoded": lambda: decoded, "n_tokens": lambda: len(own), "ids_sha256": lambda: digest(",".join(map(numeral, own)).encode()), "decoded_sha256": lambda: digest(decoded.encode())}  # noqa: B023
                for c, out in found.items():
                    out.append(values[c]())
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array(found[c], OUTPUTS[c][1]) for c in columns)], schema.names)

    return df.select(*key, F.col(text).alias("__text")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text decoded from them, as digests."""
    return round_trip(documents(spark, sf_dir), ["doc_id"], columns=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op2_bpe": op2_bpe}
