"""Secret scan: fixed patterns plus a token-efficiency test.

A string drawn at random compresses badly under a BPE vocabulary: it yields few characters per token.
Candidates that are already known to be harmless (digests in their usual lengths, UUIDs) are left out before the ratio is taken. So are identifiers: many
short parts joined by separators, as paths and version numbers are, compress badly as a whole although each part is a word or a number. A candidate
with separators is therefore tested by its parts, each with the neighbours that compress as badly; as a whole only where its parts are
all of one length, as in a key written in groups. The shorter a string, the lower the ratio must be; letters of one case alone must be longer and lower.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches

#: The kinds in the order in which ties on `start` are listed, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
LOWER, UPPER = re.compile(r"[a-z]"), re.compile(r"[A-Z]")
PART = re.compile(r"[A-Za-z0-9+]+")
ADDRESS = re.compile(r"0x[0-9A-Fa-f]+")
UUID_WITHIN = re.compile(rf"(?<![0-9A-Za-z]){UUID.pattern}(?![0-9A-Za-z])")
#: Characters of a string to test, of the part that a run of parts must hold, and of the parts of a key in groups; up to TINY a part says nothing.
LEAST, CORE, GROUP, TINY = 13, 8, 4, 2
#: Characters from which the full ratio holds, and by how much it falls with each character fewer: short words have few characters a token by chance.
FULL, SLOPE = 20, 0.04
#: Share of the ratio for letters of one case alone, which ordinary words are made of.
ONE_CASE = 0.95

SPANS = "array<struct<kind:string,start:int,end:int>>"


def vocabulary(path: str) -> tiktoken.Encoding:
    if path not in _vocabularies:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _vocabularies[path] = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


_vocabularies: dict[str, tiktoken.Encoding] = {}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every pattern match, code points, end exclusive."""
    out = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def mixed(s: str) -> bool:
    """Whether a string has letters and digits, or letters of both cases."""
    return bool(LETTER.search(s) and DIGIT.search(s) or LOWER.search(s) and UPPER.search(s))


def known(s: str) -> bool:
    return bool(UUID.fullmatch(s) or len(s) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(s))


def wasteful(s: str, encoding: tiktoken.Encoding, chars_per_token: float) -> bool:
    """Whether a string has fewer characters a token than the limit for its length and letters.

    Strings under FULL characters must have letters and digits, or letters of both cases, letters for half of them, and be no abbreviated digest or address. Longer
    ones may be of letters of one case, which are tested as small letters: words in capitals compress badly.
    """
    short, one = len(s) < FULL, not mixed(s)
    letters = len(LETTER.findall(s))
    if not letters or short and (one or 2 * letters < len(s) or HEX_ONLY.fullmatch(s) or ADDRESS.fullmatch(s)):
        return False
    limit = (chars_per_token - SLOPE * max(0, FULL - len(s))) * (ONE_CASE if one else 1)
    return len(s) < limit * len(encoding.encode_ordinary(s.lower() if one else s))


def grouped(s: str) -> bool:
    """Whether a string is of three or more parts of one length, of at least GROUP characters."""
    parts = [len(m[0]) for m in PART.finditer(s)]
    return len(parts) > 2 and min(parts) == max(parts) >= GROUP


def random_parts(s: str, encoding: tiktoken.Encoding, chars_per_token: float, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of parts of a candidate that have few characters a token, without UUIDs and digests."""
    uuids = {k for m in UUID_WITHIN.finditer(s) for k in range(m.start(), m.end())}
    runs: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(s):
        part = m[0]
        bad = len(part) < chars_per_token * len(encoding.encode_ordinary(part))
        if m.start() in uuids or known(part) or not bad and len(part) > TINY:
            runs.append([])
        elif bad and len(part) > TINY or runs[-1]:
            runs[-1].append(m.span())
    out = []
    for run in runs:
        while run and run[-1][1] - run[-1][0] <= TINY:
            run.pop()
        if not run:
            continue
        start, end = run[0][0], run[-1][1]
        found = s[start:end]
        core = any(b - a >= CORE and mixed(s[a:b]) for a, b in run)
        if core and len(found) >= least and not known(found) and wasteful(found, encoding, chars_per_token):
            out.append((start, end))
            continue
        # the run as a whole is none: each part by itself
        out += [(a, b) for a, b in run if b - a >= least and wasteful(s[a:b], encoding, chars_per_token)]
    return out


def random_spans(text: str, encoding: tiktoken.Encoding, chars_per_token: float, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Strings of `least` characters or more that the vocabulary encodes with few characters a token, as `wasteful` tells."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if len(s) < least or not mixed(s) and len(s) < FULL or known(s):
            continue
        if (PART.fullmatch(s) or grouped(s)) and wasteful(s, encoding, chars_per_token):
            out.append((m.start(), 3, m.end()))
        else:
            out += [(m.start() + a, 3, m.start() + b) for a, b in random_parts(s, encoding, chars_per_token, least)]
    return out


def find_secrets(docs: DataFrame, *, vocab: str, chars_per_token: float = 2.0, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and `secrets`, the spans of every text, by start and then kind.

    The token test takes strings of `least` characters or more (at least 8): shorter random strings can hardly be told from short names and numbers. The
    ratio `chars_per_token` holds from FULL characters on and falls below them. The patterns have no such bound.

    A null text counts as empty and has no spans; a null id stays null; repeated rows each give a row.
    Other columns are not read. Texts are scanned whole, one at a time.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary(vocab)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(text) + random_spans(text, encoding, chars_per_token, least))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "secrets"])

    picked = docs.select(id_col, text_col)
    return small_batches(picked).mapInArrow(scan, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, secrets {SPANS}")


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"), vocab=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_list(F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
        count("random").alias("n_random"),
    )
