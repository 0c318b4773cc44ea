"""BPE encoding and decoding with a pair occurrence index.

Texts are normalised and cut into words as the tokenizer's file says.  The
distinct words of a block of texts that the task does not know yet are laid out
as one sequence of symbols, and an index maps each pair that a merge knows to
all its positions in that partition of words.  Active ranks are taken in
ascending order; each merge updates the neighbouring pairs' lists.  Every merge
of this vocabulary makes a token that no other merge makes, so a new pair always
ranks behind the pair it came from and one ascending pass is exact.

Encoded words are kept from block to block up to CACHE_WORDS, so memory is
bounded whatever the texts; a single very long text is its own block.

Defined results: null counts as empty; an empty text has no ids and decodes to the
empty text; very long texts are cut after blanks and encoded whole, a very long
word is one word; repeated rows repeat; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import arrow_rows, blocks, table, texts

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 300_000
BLOCK_CHARS = 4_000_000

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Word pattern of the tokenizer's file.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


_BREAK = regex.compile(r"[ \n]")
_FIRST_UNASSIGNED = "\u0378"


@cache
def _unassigned() -> regex.Pattern:
    """Code points without a category here."""
    ranges, start = [], None
    for c in range(0x110000 + 1):
        gone = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if gone and start is None:
            start = c
        elif not gone and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return regex.compile("[" + "".join(ranges) + "]")


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + self.suffix] for c in chars]
        self.merges: dict[int, tuple[int, int]] = {}  # pair -> (rank, token)
        self.pair_of: list[tuple[int, int]] = []
        made = set()
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            token = vocab[a + b]
            if token in made:
                raise ValueError("two merges make one token: one ascending pass would not be exact")
            made.add(token)
            self.merges[vocab[a] << 20 | vocab[b]] = (rank, token)
            self.pair_of.append((vocab[a], vocab[b]))
        self.tokens = {i: t.encode() for t, i in vocab.items()}
        self.special = {}
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"].encode()
            self.special[t["content"]] = t["id"]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then each character's lower case (no final-sigma rule)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens.

        Characters that this Python's Unicode tables do not know may be letters
        to the tokenizers library; texts that hold one are cut by the library.
        """
        if text.isascii() or max(text) < _FIRST_UNASSIGNED or not _unassigned().search(text):
            return _WORD.findall(self.normalise(text))
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in cut]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words at once over one pair occurrence index."""
        symbols: list[int] = [-1]
        ends = []
        for word in words:
            data = word.encode()
            symbols += [self.inner[b] for b in data[:-1]]
            symbols.append(self.final[data[-1]])
            symbols.append(-1)  # no merge knows a word's border
            ends.append(len(symbols) - 1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, find = self.merges, self.merges.get
        index: dict[int, list[int]] = {}
        for i in range(1, n - 2):
            if (b := symbols[i + 1]) >= 0 and (a := symbols[i]) >= 0 and (known := find(a << 20 | b)):
                index.setdefault(known[0], []).append(i)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b = self.pair_of[rank]
            token = merges[a << 20 | b][1]
            for i in index.pop(rank):  # ascending positions: the leftmost of overlapping occurrences wins
                if symbols[i] != a or symbols[j := after[i]] != b:
                    continue  # a neighbour was merged meanwhile
                symbols[i], symbols[j] = token, -2
                k = after[i] = after[j]
                before[k] = i
                if (left := symbols[p := before[i]]) >= 0 and (known := find(left << 20 | token)):
                    if known[0] in index:
                        index[known[0]].append(p)
                    else:
                        index[known[0]] = [p]
                        heapq.heappush(active, known[0])
                if (right := symbols[k]) >= 0 and (known := find(token << 20 | right)):
                    if known[0] in index:
                        index[known[0]].append(i)
                    else:
                        index[known[0]] = [i]
                        heapq.heappush(active, known[0])
        out, start = [], 1
        for end in ends:
            out.append([s for s in symbols[start:end] if s >= 0])
            start = end + 1
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            for word, ids in zip(some, self.encode_words(some)):
                self.cache[word] = b"".join(i.to_bytes(4, "little") for i in ids)

    def encode_block(self, block: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A text longer than a block is cut after blanks, which no word holds and no
        normalisation crosses, and encoded by pieces.
        """
        if len(block) == 1 and len(block[0]) > 2 * BLOCK_CHARS:
            return [b"".join(self._encode([piece])[0] for piece in pieces(block[0]))]
        return self._encode(block)

    def _encode(self, block: list[str]) -> list[bytes]:
        cut, wanted = [], set()
        for text in block:
            parts = []
            for piece in self.split_special.split(text) if "<|" in text else (text,):
                if piece in self.special:
                    parts.append(piece)
                else:
                    words = self.words(piece)
                    wanted.update(words)
                    parts.append(words)
            cut.append(parts)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self._learn(wanted)
        find = self.cache.__getitem__
        return [b"".join(self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(find, p)) for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the file names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def pieces(text: str, size: int | None = None):
    """A long text cut after spaces or line ends into pieces of about ``size`` characters."""
    size, at = size or BLOCK_CHARS, 0
    while len(text) - at > 2 * size and (cut := _BREAK.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = bpe(path)
        for batch in batches:
            ids = [x for block in blocks(texts(batch), BLOCK_CHARS) for x in own.encode_block(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        own = bpe(path)
        for batch in batches:
            ids = batch.column(0)
            at = 0
            for block in blocks(texts(batch), BLOCK_CHARS):
                out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                for encoded in own.encode_block(block):
                    out["n_tokens"].append(len(encoded) // 4)
                    out["ids_sha256"].append(hashlib.sha256(encoded).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(own.decode(encoded)).hexdigest())
                yield arrow_rows(_SCHEMA, out | {"doc_id": ids.slice(at, len(block))})
                at += len(block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
