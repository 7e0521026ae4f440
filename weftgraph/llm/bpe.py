"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, table

#: Stands for the end of a word; no byte has this code.
END = "\u0100"
#: Characters with the property White_Space (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the vocabulary's file splits normalised text (fixed values).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
#: Entries of a cache at most; a full one starts anew.
CACHE = 1 << 17
#: Values that are worked on together at most.
ROWS = 256
OUT = ("ids", "n_tokens")


def _printable() -> dict[str, str]:
    """The characters that byte-level vocabularies write for bytes, and the bytes' own codes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(other)}


class WordBpe:
    """A vocabulary whose tokens either go on or end a word (suffix </w>).

    A token is written as the string of its bytes' codes, with END behind it if it ends a word.
    Merging runs by rank, and what a merge makes is only merged later, so a token exists from the
    rank that made it to the rank that uses it up. Two tokens may stand side by side if no pair of
    tokens at their touching edges merges while both exist (compatible()). An encoding in which all
    neighbours are compatible is the one that merging gives, and each prefix of a word has at most
    one, so a depth-first walk that tries longer matches first and never returns to a position that
    failed finds it in linear time.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        codes = _printable()
        suffix = model["end_of_word_suffix"]

        def plain(token: str) -> str:
            ends = token.endswith(suffix)
            return "".join(codes[c] for c in (token[: -len(suffix)] if ends else token)) + END * ends

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {plain(t): i for t, i in model["vocab"].items() if t not in self.special}
        n = 1 + max([*self.ids.values(), *self.special.values()])
        self.rank = [-1] * n  # of the merge that makes a token
        self.sides: list[tuple[int, int] | None] = [None] * n
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, made = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            self.merges[a, b] = rank
            self.rank[made], self.sides[made] = rank, (a, b)
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        made = [True] * n  # tokens that merging can arrive at
        for token in sorted(self.ids.values(), key=self.rank.__getitem__):
            if sides := self.sides[token]:
                made[token] = made[sides[0]] and made[sides[1]] and not self._crossed(*sides, self.rank[token])
        self.whole = {t: i for t, i in self.ids.items() if made[i]}
        self.matches = ahocorasick.Automaton()
        for t, i in self.whole.items():
            self.matches.add_word(t, (len(t) - 1, i))
        self.matches.make_automaton()
        special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.specials = regex.compile(f"({special})") if special else None
        # the offset table: token i is blob[offsets[i] : offsets[i + 1]], a space behind it
        strings = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        blobs = [(strings.get(i, "") + " ").encode() for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of a token, from itself inwards, with the rank that uses each up."""
        found = self._spines.get((token, side))
        if found is None:
            found, until, at = [], len(self.merges), token
            while True:
                found.append((at, until))
                if self.sides[at] is None:
                    break
                until, at = self.rank[at], self.sides[at][side]
            self._spines[token, side] = found
        return found

    def _crossed(self, left: int, right: int, before: int) -> bool:
        """Whether something merges across the border of left and right at a rank below `before`."""
        for a, a_until in self._spine(left, 1):
            for b, b_until in self._spine(right, 0):
                rank = self.merges.get((a, b))
                # of equal pairs the one further left merges first
                if rank is not None and rank < before and rank < a_until and rank <= b_until:
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._crossed(left, right, len(self.merges))
        return known

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of one word, given as its bytes' codes."""
        word += END
        if (token := self.whole.get(word)) is not None:
            return (token,)
        n = len(word)
        options: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (back, token) in self.matches.iter(word):
            options[last - back].append((last + 1, token))  # longer ones come later
        failed = {n - 1}  # the sign of the end belongs to the token before it
        path: list[tuple[int, int, int]] = []
        at, k = 0, len(options[0])
        while at < n:
            before = path[-1][1] if path else None
            here = options[at]
            while k:
                k -= 1
                end, token = here[k]
                if end not in failed and (before is None or self.compatible(before, token)):
                    path.append((at, token, k))
                    at = end
                    k = len(options[at]) if at < n else 0
                    break
            else:
                failed.add(at)
                at, _, k = path.pop()
        return tuple(token for _, token, _ in path)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text; strings of special tokens give their ids."""
        out: list[int] = []
        words, extend = self._words, out.extend
        for part in self.specials.split(text or "") if self.specials else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            # lower case is taken character by character, without the final form of sigma
            for piece in _PIECES.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()):
                found = words.get(piece)
                if found is None:
                    if len(words) >= CACHE:
                        words.clear()
                    found = words[piece] = self.word(piece.encode().decode("latin-1"))
                extend(found)
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings, joined by a space, in UTF-8."""
        parts = []
        for at in range(0, len(ids), 65_536):
            some = ids[at : at + 65_536]
            sizes = self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            parts.append(self.blob[np.arange(ends[-1]) + np.repeat(self.offsets[some] - ends + sizes, sizes)].tobytes())
        return b"".join(parts)[:-1]


@lru_cache(maxsize=2)
def _vocabulary(text: str) -> WordBpe:
    return WordBpe(text)


def _columns(docs: DataFrame, column: str, out: list[str], schema: str, vocabulary: str, each) -> DataFrame:
    """docs with columns `out`, which `each` makes of some values of `column` at a time. Only that
    column goes to Python."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _vocabulary(spec.value)
        for batch in batches:
            for some in _slices(batch):
                yield pa.StructArray.from_arrays(each(coder, some), names=out)
            if not len(batch):
                yield pa.StructArray.from_arrays(each(coder, batch), names=out)

    made = F.arrow_udf(run, schema)(F.col(column))
    return docs.select(as_row(docs, *out), made.alias("_made")).select("_row.*", "_made.*")


def _slices(batch: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """A batch in parts of at most ROWS values and about `most` bytes, or one value."""
    at = 0
    while at < len(batch):
        n = min(ROWS, len(batch) - at)
        while n > 1 and batch.slice(at, n).nbytes > most:
            n //= 2
        yield batch.slice(at, n)
        at += n


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids (array of int) and n_tokens (long): the whole text's tokens, no special tokens
    added; with `decoded` also the column of bpe_decode(), from the same pass. The vocabulary file is
    read by the driver and sent to the tasks.

    Null and empty texts have no tokens. Rows are independent: repeated rows repeat and ties can't
    arise. Input columns named like an output are replaced, all others stay, whatever their names.
    An empty table gives no rows.
    """

    def each(coder: WordBpe, texts: pa.Array) -> list[pa.Array]:
        ids = [coder.encode(t) for t in texts.to_pylist()]
        counts = np.array([len(x) for x in ids], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32()))
        back = [pa.array([coder.decode(x) for x in ids], pa.binary()).cast(pa.string())] if decoded else []
        return [lists, pa.array(counts), *back]

    d = docs.select(as_row(docs, *OUT, *["decoded"] * decoded), F.col(text).cast("string").alias("_text"))
    made = _columns(d, "_text", [*OUT, *["decoded"] * decoded], "ids array<int>, n_tokens long" + ", decoded string" * decoded, vocabulary, each)
    return made.select("_row.*", *OUT, *["decoded"] * decoded)


def bpe_decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """docs with decoded (string): the tokens of the column ids, joined by a space. Null or no ids
    give an empty string; an id that the vocabulary lacks is an error. Rows are independent; an input
    column decoded is replaced. An empty table gives no rows."""

    def each(coder: WordBpe, lists: pa.Array) -> list[pa.Array]:
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return [pa.array([coder.decode(values[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)], pa.binary()).cast(pa.string())]

    d = docs.select(as_row(docs, "decoded"), F.col(ids).alias("_ids"))
    return _columns(d, "_ids", ["decoded"], "decoded string", vocabulary, each).select("_row.*", "decoded")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """bpe_encode() of all documents and the digests of ids and decoded text; nulls, empty texts,
    repeats, an empty table and further columns as stated there."""
    out = bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary or default_vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
