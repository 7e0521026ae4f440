"""Byte-level byte-pair encoding with the tokenizers library over Arrow batches, offsets in characters,
and decoding through the reversed byte table."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, by_bytes, table

#: Characters of a text that the library gets at a time, as far as the text has white space.
PART = 1 << 16
#: Pieces of at most so many characters are remembered with their tokens, at most so many of them; a
#: full memory starts anew.
SHORT, MEMORY = 64, 1 << 17
#: New pieces that the library gets as the words of one text.
GROUP = 1 << 13
OUT = ("ids", "starts", "ends", "n_tokens")
BACK = ("decoded", "decoded_bytes")
#: A character that is no white space, and a blank or line break: every match of a pattern whose
#: alternatives hold no character of this kind behind another one ends between the two.
_BORDER = re.compile(r"[^\s][ \n]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on in their order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = (b for b in range(256) if b not in set(plain))
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + i)) for i, b in enumerate(rest)])]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes this one when its own bytes are merged by rank, or None if
    merging stops before (such a token stands only for a whole piece).

    A pair in a text whose bytes make this token was made from the same bytes by the same merges,
    since no merge crossed its borders, so no other pair of the same bytes can meet.
    """
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best > len(ranks):
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(path: str, pattern: str) -> str:
    """A rank file as a tokenizer of the library: its bytes as characters, one merge for each token in
    the order of ranks, pieces that are tokens taken whole."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no token for the bytes {missing}")
    shown = lambda token: "".join(chars[b] for b in token)
    pairs = (last_merge(t, ranks) for t in sorted(ranks, key=ranks.__getitem__))
    made = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=[(shown(a), shown(b)) for a, b in filter(None, pairs)], ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


@lru_cache(maxsize=1)
def unlike_characters() -> str:
    """The characters that the tokenizers library and the regex module class differently as letters,
    numbers or white space, since they know different versions of Unicode; as ranges for a pattern."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    unlike: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        split = pre_tokenizers.Split(Regex(kind), "removed", invert=True)
        unlike |= {c for found, _ in split.pre_tokenize_str(every) for c in found} ^ set(regex.findall(kind, every))
    codes = np.array(sorted(map(ord, unlike)), np.int64)
    runs = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1) if len(codes) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


class Numbers(dict):
    """Numbers of pieces in the order in which they were first asked for; `new` are those whose tokens
    aren't known yet."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = n = self.next
        self.new.append(piece)
        self.next += 1
        return n


class ByteBpe:
    """A tokenizer of the library, by its JSON. If `pattern` is given, texts without a character of
    `unlike` are split by the regex module, and the library gets each new piece once; other texts are
    split by the library."""

    def __init__(self, spec: str, pattern: str | None = None, unlike: str = "") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.piece = Tokenizer.from_str(spec), Tokenizer.from_str(spec)
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern) if pattern else None
        self.unlike = re.compile(f"[{unlike}]") if unlike else None
        self._forget()
        back = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.whole.get_vocab()
        tokens = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            tokens[i] = bytes(back[c] for c in token)
        self.known = np.array([bool(t) for t in tokens])
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; long texts go in parts."""
        parts, owners = [], []
        for i, text in enumerate(texts):
            for part in in_parts(text):
                parts.append(part)
                owners.append(i)
        ids: list[list[np.ndarray]] = [[] for _ in texts]
        for some in by_bytes([len(p) for p in parts], 4 * PART):
            for i, got in zip(owners[some], self._encode(parts[some]), strict=True):
                ids[i].append(got)
        return [np.concatenate([np.empty(0, np.int32), *x]) for x in ids]

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        alike = [self.pattern is not None and (p.isascii() or self.unlike is None or not self.unlike.search(p)) for p in parts]
        other = iter(self.whole.encode_batch_fast([p for p, x in zip(parts, alike, strict=True) if not x], add_special_tokens=False))
        if len(self.memory) > MEMORY or len(self.flat) > 16 * MEMORY:
            self._forget()
        found = []
        for part, x in zip(parts, alike, strict=True):
            pieces = self.pattern.findall(part) if x else []
            found.append(np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces)))
        self._learn()
        out = [self._tokens(n) if x else np.array(next(other).ids, np.int32) for n, x in zip(found, alike, strict=True)]
        for piece in [x for x in self.memory.new if len(x) > SHORT]:
            del self.memory[piece]
        self.memory.new = []
        return out

    def _forget(self) -> None:
        """Start the memory of pieces anew: number n has the tokens flat[begin[n] : begin[n] + count[n]]."""
        self.memory = Numbers()
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        """Tokens of the pieces that were numbered since the last time."""
        for at in range(0, len(self.memory.new), GROUP):
            some = self.memory.new[at : at + GROUP]
            got = self.piece.encode(some, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.flat = np.concatenate([self.flat, np.array(got.ids, np.int32)])

    def _tokens(self, pieces: np.ndarray) -> np.ndarray:
        counts = self.count[pieces]
        ends = np.cumsum(counts)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[pieces] - ends + counts, counts)]

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the first character it has a byte of, and the one behind its last."""
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # the character of each byte
        ends = np.cumsum(self.sizes[ids])
        return char[ends - self.sizes[ids]].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, in parts of 65,536 tokens."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        out = []
        for at in range(0, len(ids), 65_536):
            some = ids[at : at + 65_536]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            out.append(self.blob[np.arange(ends[-1]) + np.repeat(self.begins[some] - ends + sizes, sizes)].tobytes())
        return b"".join(out)


def in_parts(text: str, most: int = PART) -> Iterator[str]:
    """A text in parts of about `most` characters, cut where a piece of the pattern ends for sure."""
    at = 0
    while len(text) - at > most and (border := _BORDER.search(text, at + most - 1)):
        yield text[at : border.start() + 1]
        at = border.start() + 1
    yield text[at:]


@lru_cache(maxsize=2)
def _coder(*spec: str) -> ByteBpe:
    return ByteBpe(*spec)


def spec(vocabulary: str, pattern: str | None = None) -> tuple[str, ...]:
    """What a task needs to encode; only of the default pattern the two kinds of split are known to
    agree."""
    if pattern not in (None, default_pattern()):
        return (tokenizer_json(vocabulary, pattern),)
    return tokenizer_json(vocabulary, default_pattern()), default_pattern(), unlike_characters()


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))


def _with(docs: DataFrame, column: str, schema: str, spec: tuple, each) -> DataFrame:
    """docs (_row, column) with the columns that `each` makes of a megabyte of values at a time; only
    that column goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(*sent.value)
        for batch in batches:
            for some in [*slices(batch)] or [slice(0, 0)]:
                yield pa.StructArray.from_arrays(each(coder, batch[some]), names=names)

    made = F.arrow_udf(run, schema)(F.col(column))
    return docs.select("_row", made.alias("_made")).select("_row.*", "_made.*")


def slices(batch: pa.Array) -> Iterable[slice]:
    """Slices of about a megabyte, by the values' own sizes."""
    kind = batch.type
    if pa.types.is_list(kind):
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * 4
    else:
        sizes = pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
    return by_bytes((int(s) + 64 for s in sizes))


def byte_bpe_encode(docs: DataFrame, vocabulary: str, pattern: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids, starts, ends (arrays of int) and n_tokens (long): the whole text's tokens by the
    ranks of a rank file, each match of the pattern by itself, and the characters (from 0, end
    exclusive, in code points) that a token has bytes of. Tokens that share a character have
    overlapping characters.

    The driver reads the vocabulary and sends it to the tasks. The pattern must match every character
    and must not match white space behind other characters (`\\s` alternatives begin a match), as
    public byte-level patterns do; long texts are cut by that. Null and empty texts have no tokens. A
    text without any white space is handed over whole. Rows are independent: repeated rows repeat,
    ties can't arise. Input columns named like an output are replaced, others stay. An empty table
    gives no rows.
    """

    def each(coder: ByteBpe, texts: pa.Array) -> list[pa.Array]:
        whole = [t or "" for t in texts.to_pylist()]
        ids = coder.encode(whole)
        spans = [coder.offsets(t, i) if len(i) else (i, i) for t, i in zip(whole, ids, strict=True)]
        return [_lists(ids), _lists([a for a, _ in spans]), _lists([b for _, b in spans]), pa.array([len(i) for i in ids], pa.int64())]

    d = docs.select(as_row(docs, *OUT), F.col(text).cast("string").alias("_text"))
    return _with(d, "_text", "ids array<int>, starts array<int>, ends array<int>, n_tokens long", spec(vocabulary, pattern), each)


def byte_bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """docs with decoded_bytes (binary), the bytes of the tokens, and decoded (string): the same as
    text, in which bytes that are no whole character (a list of ids may begin or end inside of one)
    are shown as U+FFFD. Null or no ids give no bytes; an id that the vocabulary lacks is an error.
    Rows are independent; input columns named like an output are replaced. An empty table gives no
    rows."""

    def each(coder: ByteBpe, lists: pa.Array) -> list[pa.Array]:
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        back = [coder.decode(values[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)] if len(lists) else []
        return [pa.array([b.decode(errors="replace") for b in back], pa.string()), pa.array(back, pa.binary())]

    d = docs.select(as_row(docs, *BACK), F.col(ids).cast("array<int>").alias("_ids"))
    return _with(d, "_ids", "decoded string, decoded_bytes binary", spec(vocabulary), each)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op13_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """byte_bpe_encode() and byte_bpe_decode() of all documents as digests, and n_shared: tokens that
    begin inside a character which the token before has begun. Nulls, empty texts, repeats, an empty
    table and further columns as stated there."""
    vocabulary = vocabulary or default_vocabulary()
    coded = byte_bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    follows = F.zip_with(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda a, b: a < b)
    kept = coded.select("doc_id", "ids", "n_tokens", F.size(F.filter(follows, lambda x: x)).cast("long").alias("n_shared"))
    back = byte_bpe_decode(kept, vocabulary)
    return back.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded_bytes", 256).alias("decoded_sha256"), "n_shared")
