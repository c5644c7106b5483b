"""Token counts by finite-state transducers compiled from a byte-pair vocabulary.

Two deterministic transducers annotate their transitions.

*Words.* The pre-tokenizer's pattern becomes an automaton of a dozen states over character
classes; a transition says at which of the last characters words begin. Texts are laid end
to end and cut into lanes that run in lockstep in numpy. Each lane first runs from every
state, until all runs agree, which gives the lane's state map; the maps compose in a parallel
prefix scan, and with its true first state known each lane marks its words.

*Tokens.* A byte sequence has exactly one tokenization in which any two neighbouring tokens
are what merging their bytes gives, and so has each of its prefixes. When a byte is read, the
last token of the new prefix follows from, for every suffix that can still begin a token, the
last token before that suffix. These form the state; a transition carries the number of
tokens by which the count changes. States are built as words need them and are forgotten
together at ``MAX_STATES``, within a word too; words seen before are not run again.

Defined cases: null and empty texts have no tokens; the special string ``<|endoftext|>`` is
one token, as the library has it by default; texts are read whole; rows that repeat get equal
results; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, documents, map_arrow, texts_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK_CHARS = 1 << 20
LANE = 512
#: Steps after which a lane's runs from all states mostly agree.
AGREE = 16
MAX_STATES = 300_000
MAX_WORDS = 400_000
#: Characters of a word that is remembered, at most.
LONG_WORD = 256

END, SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, UNKNOWN = range(8)
# The contractions of the pre-tokenizer's pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Letters of the contractions have classes of their own.
OWN = {c: 8 + i for i, c in enumerate(sorted(set("".join(CONTRACTIONS))))}
CLASSES = 8 + len(OWN)


def run_class(c: int) -> int:
    """The class as which a character counts inside a word."""
    return LETTER if c in OWN.values() else OTHER if c == QUOTE else c


def begun(c: int) -> tuple[tuple, int]:
    """State and marks after a character at which a word begins. Bit k: a word begins k back."""
    if c == END:
        return ("free",), 1
    if c in (SPACE, BLANK):
        return ("blank", c == SPACE, False), 1
    return (("quote", "") if c == QUOTE else ("run", run_class(c))), 1


def moved(state: tuple, c: int) -> tuple[tuple, int]:
    """The automaton as rules; ``automaton`` turns them into tables."""
    if state[0] == "free":
        return begun(c)
    if state[0] == "run":
        return (state, 0) if run_class(c) == state[1] else begun(c)
    if state[0] == "blank":
        _, space, several = state
        if c in (SPACE, BLANK):
            return ("blank", c == SPACE, True), 0
        if c == END:
            return begun(c)
        # Of several blanks the last is apart; a space goes with the word that follows.
        after, mark = (("run", run_class(c)), 0) if space else begun(c)
        return after, mark | 2 * several
    _, seen = state
    letter = next((x for x, k in OWN.items() if k == c), None)
    if letter and seen + letter in CONTRACTIONS:
        return ("free",), 0
    if letter and any(x.startswith(seen + letter) for x in CONTRACTIONS):
        return ("quote", seen + letter), 0
    if not seen:
        return (("run", OTHER), 0) if run_class(c) == OTHER else begun(c)
    # No contraction: the quote stands alone, its letters begin a word.
    after, mark = (("run", LETTER), 0) if run_class(c) == LETTER else begun(c)
    return after, mark | 1 << len(seen)


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, flat by state and class; state 0 is the first."""
    number, rows = {("free",): 0}, []
    for state in (order := [("free",)]):
        row = []
        for c in range(CLASSES):
            after, mark = moved(state, c)
            if after not in number:
                number[after] = len(number)
                order.append(after)
            row.append((number[after], mark))
        rows.append(row)
    table = np.array(rows, dtype=np.uint8)
    return np.ascontiguousarray(table[:, :, 0]).ravel(), np.ascontiguousarray(table[:, :, 1]).ravel()


def lane_maps(lanes: np.ndarray) -> np.ndarray:
    """The state map of each lane. ``lanes``: classes, one column a lane."""
    after, _ = automaton()
    n = len(after) // CLASSES
    state = np.repeat(np.arange(n, dtype=np.uint8)[:, None], lanes.shape[1], axis=1)
    for row in lanes[:AGREE]:
        state = after[state.astype(np.intp) * CLASSES + row]
    agree = (state == state[0]).all(axis=0)
    one = state[0, agree].astype(np.intp)
    for row in lanes[AGREE:, agree]:
        one = after[one * CLASSES + row].astype(np.intp)
    rest = state[:, ~agree].astype(np.intp)
    for row in lanes[AGREE:, ~agree]:
        rest = after[rest * CLASSES + row].astype(np.intp)
    out = np.empty((lanes.shape[1], n), dtype=np.intp)
    out[agree] = one[:, None]
    out[~agree] = rest.T
    return out


def first_states(maps: np.ndarray) -> np.ndarray:
    """The state in which each lane begins: an exclusive prefix scan of map composition."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return np.concatenate([[0], maps[:-1, 0]])


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Where words begin (and where texts end) in an array of classes that ends with END."""
    after, marks = automaton()
    n = -(-len(classes) // LANE)
    lanes = np.full(n * LANE, END, dtype=np.uint8)
    lanes[: len(classes)] = classes
    lanes = np.ascontiguousarray(lanes.reshape(n, LANE).T).astype(np.intp)
    state = first_states(lane_maps(lanes))
    found = np.empty((LANE, n), dtype=np.uint8)
    for i, row in enumerate(lanes):
        at = state * CLASSES + row
        found[i] = marks[at]
        state = after[at].astype(np.intp)
    mask = np.ascontiguousarray(found.T).ravel()[: len(classes)]
    begins = (mask & 1).astype(bool)
    for back in range(1, 3):
        begins[:-back] |= (mask[back:] >> back & 1).astype(bool)
    return np.nonzero(begins)[0]


class Counter:
    """Both transducers of one vocabulary file, with what they have built so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        form = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or form["type"] != "ByteLevel" or form["add_prefix_space"] or not form["use_regex"]:
            raise ValueError(f"{path} is not a byte-level BPE file of the kind that this module compiles")
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.pieces = Tokenizer.from_file(path).pre_tokenizer
        self.byte = {c: b for b, c in enumerate(byte_characters())}
        self.token = {self.spelled(t): i for t, i in spec["model"]["vocab"].items()}
        self.spelling = {i: t for t, i in self.token.items()}
        self.rank = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.token[self.spelled(t)] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = i, self.token[self.spelling[a] + self.spelling[b]]
        self.children: dict[tuple[int, int], int] = {}
        self.ends: list[int | None] = [None]
        self.inner: set[int] = set()
        for t, i in self.token.items():
            node = 0
            for b in t:
                self.inner.add(node)
                if (node, b) not in self.children:
                    self.children[node, b] = len(self.ends)
                    self.ends.append(None)
                node = self.children[node, b]
            self.ends[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()
        self.words: dict[str, int] = {}
        self.classes = class_table()

    def spelled(self, token: str) -> bytes:
        return bytes(self.byte[c] for c in token)

    def forget(self, kept: tuple = ((0, -1, 0),)) -> int:
        """Drop all states but the first and ``kept``, whose new number is returned."""
        first = ((0, -1, 0),)
        self.of: list[tuple] = [first] if kept == first else [first, kept]
        self.states: dict[tuple, int] = {s: i for i, s in enumerate(self.of)}
        self.parts: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        self.moves: dict[int, int] = {}
        return len(self.of) - 1

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a short byte sequence, by its merges in order of rank."""
        out = [self.token[bytes([b])] for b in data]
        while len(out) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.rank[out[i], out[i + 1]][1]]
        return out

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: first)."""
        key = last, token
        if key not in self.fits:
            if len(self.fits) > 20 * MAX_WORDS:
                self.fits.clear()
            before = self.spelling[last] if last >= 0 else b""
            self.fits[key] = self.merged(before + self.spelling[token]) == ([last] if last >= 0 else []) + [token]
        return self.fits[key]

    def move(self, state: int, byte: int) -> int:
        """Next state, times 256, plus the change of the count, plus 128; built on first use.

        A state is a tuple of (trie node of a suffix, last token before the suffix, count
        before the suffix less count of all).
        """
        open_, count, last = [], None, None
        for node, before, less in self.of[state]:
            child = self.children.get((node, byte))
            if child is None:
                continue
            token = self.ends[child]
            if count is None and token is not None and self.follows(before, token):
                count, last = less + 1, token
            if child in self.inner:
                open_.append((child, before, less))
        assert count is not None, "every prefix has a tokenization"
        new = tuple([self.parts.setdefault(x, x) for x in [*((n, b, less - count) for n, b, less in open_), (0, last, 0)]])
        if new not in self.states:
            self.states[new] = len(self.of)
            self.of.append(new)
        self.moves[state << 8 | byte] = move = self.states[new] << 8 | count + 128
        return move

    def word(self, word: str) -> int:
        """The number of tokens of one word."""
        state = total = 0
        moves, data = self.moves, word.encode()
        for byte in data:
            move = moves.get(state | byte)
            if move is None:
                if len(self.of) > MAX_STATES:
                    state = self.forget(self.of[state >> 8]) << 8
                    moves = self.moves
                move = self.move(state >> 8, byte)
            state = move & ~255
            total += move & 255
        return total - 128 * len(data)

    def classify(self, code: np.ndarray) -> np.ndarray:
        """Classes of code points; the library is asked about those too new for Python's tables."""
        classes = self.classes[code]
        if (classes == UNKNOWN).any():
            for c in np.unique(code[classes == UNKNOWN]).tolist():
                joins = lambda x: len(self.pieces.pre_tokenize_str(x + chr(c))) == 1  # noqa: B023, E731
                self.classes[c] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else BLANK
            classes = self.classes[code]
        return classes

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text of a block."""
        parts, owner, total = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.specials:
                pieces = [x for p in pieces for x in p.split(special)]
            total[i] += len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        if not any(parts):
            return total.tolist()
        stream = "\0".join([*parts, ""])
        code = np.frombuffer(stream.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classify(code)
        classes[ends] = END
        starts = word_starts(classes)
        real = classes[starts] != END
        words = [stream[a:b] for a, b, ok in zip(starts.tolist(), starts[1:].tolist(), real.tolist(), strict=False) if ok]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known, long = self.words, {}
        for w in set(words).difference(known):
            (known if len(w) <= LONG_WORD else long)[w] = self.word(w)
        n = np.fromiter((known[w] if w in known else long[w] for w in words) if long else map(known.__getitem__, words), dtype=np.int64, count=len(words))
        part = np.searchsorted(ends, starts[real])
        total += np.bincount(np.asarray(owner)[part], weights=n, minlength=len(texts)).astype(np.int64)
        return total.tolist()


def byte_characters() -> list[str]:
    """The character by which byte-level vocabularies write each byte.

    Printable Latin-1 bytes stand for themselves; the others, in order, for the code points from 256.
    """
    out, spare = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        out.append(chr(b if plain else spare))
        spare += not plain
    return out


def class_table() -> np.ndarray:
    """The class of every code point; UNKNOWN where Python's Unicode tables have none."""
    by = {"L": LETTER, "N": NUMBER}
    table = np.empty(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        table[c] = UNKNOWN if category == "Cn" else by.get(category[0], OTHER)
    for c in range(0x3001):
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            table[c] = BLANK
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letter, c in OWN.items():
        table[ord(letter)] = c
    return table


@cache
def counter(vocabulary: str) -> Counter:
    import public_tokenizers

    return Counter(public_tokenizers.path(vocabulary))


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes and n_tokens, one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, made = texts_of(batch), counter(vocabulary)
        n: list[int] = []
        for part in blocks([len(t) for t in texts], BLOCK_CHARS):
            n += made.counts(texts[part])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return map_arrow(docs.select("doc_id", size.alias("n_bytes"), "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
