"""Byte-level BPE: encoding by replaying the merges over the words of the corpus, and decoding.

A text splits into words by the vocabulary's pattern; a word's tokens depend on nothing but the word. A first pass gathers the
corpus's words: each block of text gives its distinct ones, Spark counts the blocks that hold a word, and the merges are replayed once
over all the words of several blocks together: an inverted index maps each mergeable pair to the positions
where it stands, the merges are applied in rank order, and a merge looks again only at the two neighbours of the place it changed.
The tokens of the words that most blocks hold, up to a fixed number, go to every task. A task replays what is left, the rare words of
its own text, in the same way; nothing but words is shuffled, and no step holds more than a fixed amount of text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, read, small_batches

#: Bytes of text that are split and encoded together; bytes of new words that are replayed together; words that a task keeps.
BLOCK_BYTES, REPLAY_BYTES, CACHE_WORDS = 12_000_000, 1_500_000, 250_000
#: Distinct words of a block of the first pass, words whose tokens go to every task, and bytes of them.
PASS_WORDS, SHARED_WORDS, SHARED_BYTES = 200_000, 150_000, 16_000_000
DECODE_ROWS = 500

#: Letters and numbers of Unicode 17, which the regex module has and the tiktoken library has not.
NEWER = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A text's words by `pattern`. By public_tokenizers.PATTERN it takes the letters and numbers that the tiktoken library knows; other patterns hold as the regex module reads them."""
    usual, newer = regex.compile(pattern).findall, regex.compile(f"[{NEWER}]").search
    if pattern != public_tokenizers.PATTERN:
        return usual
    older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])")
    for kind in ("L", "N"):
        older = older.replace(rf" ?\p{{{kind}}}+", rf" ?(?:(?![{NEWER}])\p{{{kind}}})+")
    unusual = regex.compile(older).findall

    def words(text: str) -> list[str]:
        if text.isascii() or np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16).max() < ord(NEWER[0]) or not newer(text):
            return usual(text)
        return unusual(text)

    return words


class Vocabulary:
    """Ranks of a .tiktoken file; a token's id is its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ids.values()) + 1
        #: marks a position that has been merged into the one before it
        self.dead = size
        if size >= 1 << 31:
            raise ValueError("token ids must stay below 2**31 - 1")
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        halves = [(t, rank, k) for t, rank in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        keys = np.array([self.pair(self.ids[t[:k]], self.ids[t[k:]]) for t, _, k in halves] + [-1])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([rank for _, rank, _ in halves] + [-1])[order]
        # tokens that may join a neighbour at a rank below their own
        self.urgent = {part for t, rank, k in halves for part in (self.ids[t[:k]], self.ids[t[k:]]) if rank < part}

    def pair(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return np.int64(a) * (self.dead + 1) + b

    def merged(self, keys: np.ndarray) -> np.ndarray:
        """The token that each pair becomes, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


class Bytes:
    """The bytes of the tokens of a .tiktoken file, one after the other, with where each begins and how many it has; ids that are not there have none."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            known = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
        self.size = max(known) + 1
        lengths = [len(known.get(i, b"")) for i in range(self.size)]
        self.flat = np.frombuffer(b"".join(known.get(i, b"") for i in range(self.size)), np.uint8)
        self.lengths = np.array([*lengths, 0], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths[:-1])])

    def decoded(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids >= 0) & (ids < self.size), ids, self.size)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.first[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@dataclass
class Shared:
    """Words with their tokens, one word after the other, and where each ends."""

    words: list[str]
    tokens: np.ndarray
    ends: np.ndarray


NONE = Shared([], np.zeros(0, np.int32), np.zeros(1, np.int64))


class Numbers(dict):
    """A number for each word, by order of appearance."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


class Words:
    """The words that a task has met, by number, and their tokens; it begins with the shared ones."""

    def __init__(self, vocab: Vocabulary, shared: Shared = NONE):
        self.vocab = vocab
        self.numbers = Numbers(zip(shared.words, range(len(shared.words))))
        self.tokens, self.ends = shared.tokens, shared.ends

    def learn(self) -> None:
        """Find the tokens of the words that have a number and no tokens yet."""
        known = len(self.ends) - 1
        if known == len(self.numbers):
            return
        tokens, lengths = zip(*(replay(part, self.vocab) for part in sliced(islice(self.numbers, known, None))))
        self.tokens = np.concatenate([self.tokens, *tokens])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])

    def encoded(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words of these numbers, one after the other, and how many each has."""
        first = self.ends[words]
        lengths = self.ends[words + 1] - first
        ends = np.cumsum(lengths)
        return self.tokens[np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


def sliced(words: Iterable[str]) -> Iterator[list[bytes]]:
    """The words as bytes, in lists of up to REPLAY_BYTES; a longer word is a list of its own."""
    held, size = [], 0
    for w in words:
        raw = w.encode("utf-8", "replace")
        if held and size + len(raw) > REPLAY_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def replay(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, one word after the other, and each word's number of tokens.

    `index` maps the rank of a merge to the positions where its pair stands, with the pair as it was then. Ranks are worked off
    from the lowest, all positions of a rank at once; but in a word where that brings up a lower rank, the leftmost only.
    """
    sizes = np.array([*map(len, words)], np.int64)
    token = vocab.single[np.frombuffer(b"".join(words), np.uint8)]
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    total = len(token)
    after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
    edge = np.flatnonzero(word_of[1:] != word_of[:-1])
    after[edge], before[edge + 1] = -1, -1
    after[-1:] = -1
    index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    queue: list[int] = []

    def put(places: np.ndarray, keys: np.ndarray) -> None:
        ranks = vocab.merged(keys)
        fine = np.flatnonzero(ranks >= 0)
        fine = fine[np.argsort(ranks[fine], kind="stable")]
        ranks, places, keys = ranks[fine], places[fine], keys[fine]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append((places[a:b], keys[a:b]))

    def pairs(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return vocab.pair(a, b)

    def sooner(p: np.ndarray, q: np.ndarray, rank: int) -> np.ndarray:
        """Words in which merging these places from left to right brings up a pair of a lower rank."""
        n, b = after[q], before[p]
        left = np.where(np.append(False, b[1:] == q[:-1]), rank, token[b])
        out = []
        for there, keys in ((n >= 0, pairs(rank, token[n])), (b >= 0, pairs(left, rank))):
            new = vocab.merged(keys)
            out.append(word_of[p[there & (new >= 0) & (new < rank)]])
        return np.unique(np.concatenate(out))

    left = np.flatnonzero(after >= 0).astype(np.int32)
    put(left, pairs(token[left], token[left + 1]))
    while queue:
        rank = heapq.heappop(queue)
        entries = index.pop(rank)
        p, key = entries[0] if len(entries) == 1 else map(np.concatenate, zip(*entries))
        p, first = np.unique(p, return_index=True)
        key, q = key[first], after[p]
        stands = (q >= 0) & (pairs(token[p], token[q]) == key)
        p, q, key = p[stands], q[stands], key[stands]
        if not len(p):
            continue
        # of places that overlap, every other one from the left
        head = np.append(True, q[:-1] != p[1:])
        at = np.arange(len(p))
        take = (at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0
        if rank in vocab.urgent:
            urgent = sooner(p[take], q[take], rank)
            if len(urgent):
                wait = np.isin(word_of[p], urgent)
                wait &= np.append(False, word_of[p[1:]] == word_of[p[:-1]])
                index[rank] = [(p[wait], key[wait])]
                heapq.heappush(queue, rank)
                take &= ~wait
        p, q = p[take], q[take]
        n = after[q]
        token[p], token[q], after[p], after[q] = rank, vocab.dead, n, -1
        has_n = n >= 0
        before[n[has_n]] = p[has_n]
        b = before[p]
        has_b = b >= 0
        put(np.concatenate([p[has_n], b[has_b]]), np.concatenate([pairs(rank, token[n[has_n]]), pairs(token[b[has_b]], rank)]))
    live = token != vocab.dead
    return token[live].astype(np.int32), np.bincount(word_of[live], minlength=len(words))


def of_worker(kind: type, path: str):
    """The Vocabulary or Bytes of a path, once for each Python process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


_loaded: dict = {}


def word_blocks(texts: DataFrame, pattern: str) -> DataFrame:
    """word: the distinct words of each block of the texts, a block being what holds PASS_WORDS of them or all that a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(pattern), set()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split(text.as_py() or ""))
            if len(seen) >= PASS_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])
                seen = set()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])

    return small_batches(texts).mapInArrow(run, "word string")


def corpus_words(docs: DataFrame, *, vocab: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", most: int = SHARED_WORDS) -> Shared:
    """Tokens of the words that most blocks of the corpus hold, at least two: up to `most` words, and SHARED_BYTES of them.

    The words' number of blocks is counted for the whole corpus; the bound is on powers of two of it, so that ties are in or out together.
    """
    counts = word_blocks(docs.select(text_col), pattern).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts.select("word", F.floor(F.log2("n")).cast("int").alias("level")), "bpe-words")
    levels = counts.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.octet_length("word")).alias("b")).orderBy(F.desc("level")).collect()  # up to 64 rows
    least, n, size = None, 0, 0
    for r in levels:
        n, size = n + r.n, size + r.b
        if n > most or size > SHARED_BYTES:
            break
        least = r.level
    if least is None:
        return NONE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column(0).to_pylist()]  # SHARED_BYTES at most
        if words:
            tokens, lengths = zip(*(replay(part, of_worker(Vocabulary, vocab)) for part in sliced(words)))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))], names=["word", "ids"])

    found = counts.where(F.col("level") >= least).select("word").mapInArrow(run, "word string, ids array<int>").toArrow().combine_chunks()
    ids = found["ids"].combine_chunks()
    return Shared(found["word"].to_pylist(), ids.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64))


def over_texts(batches: Iterator[pa.RecordBatch], at: int, vocab: str, pattern: str, shared: Shared) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches with the tokens of the texts in their column `at`, one after the other, and where those of each text end, from 0.

    New words are replayed for as many batches as make up BLOCK_BYTES; a null text is empty."""
    known, split = Words(of_worker(Vocabulary, vocab), shared), splitter(pattern)
    held: list[tuple[pa.RecordBatch, np.ndarray, list[int]]] = []
    size = 0

    def encoded() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        known.learn()
        for batch, words, counts in held:
            tokens, lengths = known.encoded(words)
            yield batch, tokens, np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]

    for batch in batches:
        if not batch.num_rows:
            continue
        number = known.numbers.__getitem__
        words = [np.fromiter(map(number, split(v.as_py() or "")), np.int32) for v in batch.column(at)]
        held.append((batch, np.concatenate(words), [*map(len, words)]))
        size += batch.column(at).nbytes
        if size >= BLOCK_BYTES:
            yield from encoded()
            held, size = [], 0
            if len(known.numbers) > CACHE_WORDS + len(shared.words):
                known = Words(known.vocab, shared)
    if held:
        yield from encoded()


def encode(docs: DataFrame, *, vocab: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with `out_col`, array<int>: the ids of the whole text, without special tokens.

    A null or empty text gives an empty array. All other columns stay as they are; a column named
    `out_col` is replaced. Repeated rows each give a row. The corpus's words are counted when this is called.
    """
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, vocab=vocab, pattern=pattern, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, ends in over_texts(batches, at, vocab, pattern, shared.value):
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out_col])

    schema = T.StructType([*kept.schema, T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    return small_batches(kept).mapInArrow(run, schema)


def decode(tokens: DataFrame, *, vocab: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`tokens` with `out_col`, binary: the bytes of the ids. Null ids and ids outside the vocabulary give no bytes."""
    kept = tokens.drop(out_col)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = of_worker(Bytes, vocab)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                lists = [row.values.drop_null().to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, int) for row in part.column(at)]
                out = pa.array([table.decoded(ids) for ids in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, out_col])

    return small_batches(kept).mapInArrow(run, T.StructType([*kept.schema, T.StructField(out_col, T.BinaryType())]))


def round_trip(docs: DataFrame, *, vocab: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_tokens, ids_sha256, decoded_sha256: each text encoded as by encode(), its ids decoded as by decode(), and digests of both, in one pass.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded bytes, both in lower-case hex. Other columns are not read.
    """
    picked = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs, vocab=vocab, pattern=pattern, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = of_worker(Bytes, vocab)
        decimal = np.array([str(i) for i in range(table.size)], object)
        for part, tokens, ends in over_texts(batches, 1, vocab, pattern, shared.value):
            lists = [tokens[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
            ids = [hashlib.sha256(",".join(decimal[x].tolist()).encode()).hexdigest() for x in lists]
            back = [hashlib.sha256(table.decoded(x)).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(picked).mapInArrow(run, T.StructType([picked.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), vocab=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
