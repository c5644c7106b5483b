"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

The patterns find assigned values, access keys and long hexadecimal runs. The method looks
at every run of ``MIN_RUN`` or more key characters: text of any human kind packs several
characters into a token of a byte-pair vocabulary, a random string hardly two. Runs under
``MAX_CHARS_PER_TOKEN`` characters a token are spans of kind ``random``, unless they are a
digest (hexadecimal, of the length of a known hash), an identifier (UUID, number, words
joined by separators) or inside a span found before.

Defined cases: null and empty texts have no spans; texts are scanned whole, whatever their
length; rows that repeat get equal results; an empty table gives no rows. Other columns are
ignored, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Taken, documents, map_arrow, texts_of

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "byte_bpe_50k.tiktoken"
MIN_RUN = 16
MAX_CHARS_PER_TOKEN = 2.0

# The patterns of the base kinds.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
#: Numbers, and words (a capital at most in front, or capitals only) with short numbers, joined.
#: A run splits into its words in one way only, and nothing that matched is given back, so time is linear.
NAMED = re.compile(r"[0-9+/_=-]+|[+/_=-]*+(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+(?:[+/_=-]++(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+|[0-9]{1,12}+))*+[+/_=-]*+")


@cache
def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, vocabulary: str, most: float) -> bool:
    if HEXADECIMAL.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run) or NAMED.fullmatch(run):
        return False
    return len(run) < most * len(encoder(vocabulary).encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, in order of start, then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def random_spans(text: str, known: list[tuple[int, str, int]], vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, str, int]]:
    """Runs that fail the token-efficiency test and do not overlap a known span."""
    out, taken = [], Taken((a, b) for a, _, b in known)
    for m in RUN.finditer(text):
        if not taken.overlaps(*m.span()) and is_random(m[0], vocabulary, most):
            out.append((m.start(), "random", m.end()))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find_secrets(docs: DataFrame, *, vocabulary: str = VOCABULARY, most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, ``base`` and ``all``: arrays of (kind, start, end), one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, k, b in spans]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, every = [], []
        for text in texts_of(batch):
            first = base_spans(text)
            more = random_spans(text, first, vocabulary, most)
            base.append(as_rows(first))
            every.append(as_rows(sorted(first + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], ["doc_id", "base", "all"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, base {spans}, all {spans}")


def listed(spans: str):
    """An array of spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: list[tuple[int, str, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    counts = [count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"), count_of("all", "random").alias("n_random"))
