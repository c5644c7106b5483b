"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail and IP addresses, card and phone numbers. The field labels the words
of a text by kind from the shapes of a word and its neighbours. Words of letters alone are
outside by the model's definition, in training and in decoding, so the chain falls apart at
them into islands between outside labels. It is trained by gradient ascent on the islands of
the small table ``EXAMPLES``, and decoded exactly by Viterbi in numpy batches, many islands in
lockstep. Spans that the field finds are added where no pattern found anything; a card has to
pass Luhn, the parts of an address have to be at most 255.

Defined cases: null and empty texts have no spans; texts are scanned whole, whatever their
length; rows that repeat get equal results; an empty table gives no rows. Other columns are
ignored, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Taken, documents, map_arrow, texts_of
from .secrets import count_of, listed

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds. A number that follows a digit would be found
# from that digit on, or not at all, so the look-behind changes nothing but the time taken.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Training sentences; tagged words stand in braces after their kind.
EXAMPLES = (
    "write to {email anna.berg@mail.example.org} or come by",
    "kontakt {email info@firma.de} heute noch",
    "my address is {email j_doe99@post.example.co.uk} thanks",
    "mail {email kim.lee@example.com} and {email bo@site.net} soon",
    "écrire à {email marie-claire@exemple.fr} avant lundi",
    "server at {ip 10.0.0.17} is down",
    "from {ip 192.168.1.254} to {ip 172.16.0.1} in 12 ms",
    "la adresse {ip 83.24.190.7} est bloquée",
    "login from {ip 203.0.113.9} at 10:45 on 3 May",
    "card {card 4111 1111 1111 1111} expires 12/27",
    "paid with {card 5500-0000-0000-0004} on 2024-01-05",
    "tarjeta {card 4012888888881881} vence pronto",
    "use {card 6011 0009 9013 9424} for order 88213",
    "the card number {card 4000056655665556} was used",
    "call {phone +1 (555) 010-4477} after six",
    "phone {phone (212) 555-0147} or fax",
    "appelez le {phone +33 1 44 55 66 77} demain",
    "tel {phone 555-010-9988} ask for Sam",
    "ring {phone +49 30 901820} or {phone +44 20 7946 0958} now",
    "number {phone (415) 555-2671} is busy and {phone 800-555-0199} too",
    "in 1998 there were 34 of 120 left",
    "on 2021-11-30 we sold 4,500 units at 3.99 each",
    "version 2.10.4 came after 2.9 and 1.0.0.dev3",
    "chapter 12, pages 345-367, section 4.2.1",
    "at 10:30 or 14:45 on 12.05.2019 in room B12",
    "the ratio is 3/4 and costs $15.00 (about 20%)",
    "see item #4411 or id 99812 of 7 (2020) too",
    "x = 3.14159 and y = 2.71828, n = 1000000",
    "user@host and @name are no addresses, a+b is none",
    "ISBN 978-3-16-148410-0 was printed 1,000 times",
    "score 3-2 after 90 minutes, 17-05 before",
    "key=a81bc81b-dead token: 77af20 || 45 | 12",
    "order 4500123 shipped (3 of 5) on 01/02/2003",
)
LABELS = ("O", *KINDS)
PLAIN = "w"
DIGITS = re.compile(r"[0-9]+")
WORD = re.compile(r"\S+")
TRAINING_STEPS = 300
RATE = 0.5
PENALTY = 0.02
SCALE = 1 << 20
#: Words of islands that are decoded in lockstep, padding included, and of an island that is decoded in segments.
LANES = 1 << 20
LONG_ISLAND = 4_096
MAX_WORDS = 300_000
#: Characters of a word that is remembered, at most.
LONG_WORD = 256


def shape(word: str) -> str:
    """Letters alone: ``w``. Else runs of letters as ``a``, digits as ``d`` with their number, marks as they are."""
    if word.isalpha():
        return PLAIN
    core = word.strip(",;:!?\"'|")
    core = core[:-1] if core.endswith(".") else core
    if not core or core.isalpha():
        return PLAIN
    out: list[str] = []
    for c in core:
        kind = "d" if c.isascii() and c.isdigit() else "a" if c.isalpha() else c
        if out and out[-1][0] == kind and kind in "ad":
            out[-1] += kind
        else:
            out.append(kind)
    return "".join(f"d{min(len(x), 8)}" if x[0] == "d" else x[0] for x in out)


def features(prev: str, this: str, after: str) -> list[str]:
    """Features of a word: its shape and traits, its neighbours' shapes."""
    digits = sum(map(int, re.findall(r"d(\d)", this)))
    return [f"0{this}", f"-{prev}", f"+{after}", f"t{this[0]}", f"n{min(digits, 9)}", f"@{'@' in this}.{this.count('.') > 0}", f".{min(this.count('.'), 4)}", f"a{'a' in this}", f"-d{this.count('-')}"]


def islands_of(shapes: list[str]) -> list[list[int]]:
    """Runs of places whose words are more than letters."""
    out: list[list[int]] = []
    for j, s in enumerate(shapes):
        if s != PLAIN:
            if out and out[-1][-1] == j - 1:
                out[-1].append(j)
            else:
                out.append([j])
    return out


class Field:
    """A trained linear-chain conditional random field."""

    def __init__(self):
        self.index: dict[str, int] = {}
        chains = [island for e in EXAMPLES for island in self.example(e)]
        width, k = len(self.index), len(LABELS)
        self.weights, self.moves = np.zeros((width, k)), np.zeros((k, k))
        for _ in range(TRAINING_STEPS):
            grad_w, grad_m = -PENALTY * self.weights, -PENALTY * self.moves
            for rows, gold in chains:
                unary = np.array([self.weights[r].sum(axis=0) for r in rows])
                unary[0] += self.moves[0]
                unary[-1] += self.moves[:, 0]
                one, two = marginals(unary, self.moves)
                # Moves from and to the outside labels around the island.
                grad_m[0] -= one[0]
                grad_m[:, 0] -= one[-1]
                grad_m[0, gold[0]] += 1
                grad_m[gold[-1], 0] += 1
                one[np.arange(len(gold)), gold] -= 1
                for r, d in zip(rows, one, strict=True):
                    np.subtract.at(grad_w, r, d)
                grad_m -= two
                np.add.at(grad_m, (gold[:-1], gold[1:]), 1)
            self.weights += RATE / len(chains) * grad_w
            self.moves += RATE / len(chains) * grad_m
        # Whole numbers add up to the same in any order, so all ways of decoding agree.
        self.weights, self.moves = (np.rint(SCALE * x).astype(np.int64) for x in (self.weights, self.moves))
        self.known: dict[tuple[str, str, str], np.ndarray] = {}
        self.shapes: dict[str, str] = {}

    def example(self, text: str) -> list[tuple[list[list[int]], np.ndarray]]:
        """The islands of an example: features of each word, and labels."""
        words, gold = [], []
        for tagged, plain in re.findall(r"\{([^}]*)\}|([^\s{}]+)", text):
            kind, *inside = tagged.split() if tagged else ("O", plain)
            words += inside
            gold += [LABELS.index(kind)] * len(inside)
        shapes = list(map(shape, words))
        around = [PLAIN, *shapes, PLAIN]
        out = []
        for run in islands_of(shapes):
            rows = [[self.index.setdefault(f, len(self.index)) for f in features(*around[j : j + 3])] for j in run]
            out.append((rows, np.array([gold[j] for j in run])))
        return out

    def unary(self, around: tuple[str, str, str]) -> np.ndarray:
        """Scores of the labels for a word's shape between its neighbours' shapes."""
        found = self.known.get(around)
        if found is None:
            if len(self.known) > MAX_WORDS:
                self.known.clear()
            rows = [self.index[f] for f in features(*around) if f in self.index]
            found = self.weights[rows].sum(axis=0)
            if sum(map(len, around)) <= LONG_WORD:
                self.known[around] = found
        return found

    def shape(self, word: str) -> str:
        found = self.shapes.get(word)
        if found is None:
            if len(self.shapes) > MAX_WORDS:
                self.shapes.clear()
            found = shape(word)
            if len(word) <= LONG_WORD:
                self.shapes[word] = found
        return found

    def decode(self, islands: list[list[np.ndarray]]) -> list[list[int]]:
        """The best labels of each island, outside labels before and after it."""
        order = sorted(range(len(islands)), key=lambda i: -len(islands[i]))
        out: list[list[int]] = [[] for _ in islands]
        at = 0
        while at < len(order):
            longest = len(islands[order[at]])
            if longest > LONG_ISLAND:
                out[order[at]] = self.decode_long(np.array(islands[order[at]]))
                at += 1
                continue
            # Islands come by length, so few lanes are padded by much.
            some = order[at : at + max(1, LANES // longest)]
            at += len(some)
            lengths = np.array([len(islands[i]) for i in some])
            best = self.moves[0] + np.array([islands[i][0] for i in some])
            back = np.zeros((longest, len(some), len(LABELS)), dtype=np.int8)
            for t in range(1, longest):
                live = int((lengths > t).sum())
                step = best[:live, :, None] + self.moves[None]
                back[t, :live] = step.argmax(axis=1)
                best[:live] = step.max(axis=1) + np.array([islands[i][t] for i in some[:live]])
            last = (best + self.moves[:, 0]).argmax(axis=1)
            for n, i in enumerate(some):
                path = [int(last[n])]
                for t in range(lengths[n] - 1, 0, -1):
                    path.append(int(back[t, n, path[-1]]))
                out[i] = path[::-1]
        return out

    def decode_long(self, unary: np.ndarray) -> list[int]:
        """The same for one long island (a row of ``unary`` a word), in segments of about the root of its length.

        All segments go in lockstep: first for every label before them, which gives the best scores at
        their ends one after the other, then from these scores with the ways back, which are followed
        from every label at the end, joined, and followed once more.
        """
        n, k = unary.shape
        size = int(np.sqrt(n))
        # The rest, under a segment, comes first; before the island only the outside label is possible.
        head = n % size
        best = np.full(k, -(1 << 50), dtype=unary.dtype)
        best[0] = 0
        first = np.zeros((head, k), dtype=np.int8)
        for t in range(head):
            step = best[:, None] + self.moves
            first[t], best = step.argmax(axis=0), step.max(axis=0) + unary[t]
        segments = unary[head:].reshape(-1, size, k)
        through = self.moves[None] + segments[:, 0, None, :]
        for t in range(1, size):
            through = (through[:, :, :, None] + self.moves).max(axis=2) + segments[:, t, None, :]
        entry = np.empty((len(segments), k), dtype=unary.dtype)
        for s, m in enumerate(through):
            entry[s] = best
            best = (best[:, None] + m).max(axis=0)
        back = np.empty((size, len(segments), k), dtype=np.int8)
        for t in range(size):
            step = entry[:, :, None] + self.moves
            back[t], entry = step.argmax(axis=1), step.max(axis=1) + segments[:, t]
        came = np.tile(np.arange(k, dtype=np.int8), (len(segments), 1))
        for t in range(size - 1, -1, -1):
            came = np.take_along_axis(back[t], came, axis=1)
        ends = np.empty(len(segments), dtype=np.int64)
        label = int((best + self.moves[:, 0]).argmax())
        for s in range(len(segments) - 1, -1, -1):
            ends[s] = label
            label = int(came[s, label])
        path, rows, at = np.empty((len(segments), size), dtype=np.int8), np.arange(len(segments)), ends
        for t in range(size - 1, -1, -1):
            path[:, t] = at
            at = back[t, rows, at]
        out = []
        for t in range(head - 1, -1, -1):
            out.append(label)
            label = int(first[t, label])
        return out[::-1] + path.ravel().tolist()


def marginals(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the labels, and expected numbers of moves, by forward and backward sums."""
    n, k = unary.shape
    forward, backward = np.zeros((n, k)), np.zeros((n, k))
    forward[0] = unary[0]
    for t in range(1, n):
        forward[t] = unary[t] + np.logaddexp.reduce(forward[t - 1][:, None] + moves, axis=0)
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(moves + unary[t + 1] + backward[t + 1], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    two = np.zeros((k, k))
    for t in range(1, n):
        two += np.exp(forward[t - 1][:, None] + moves + unary[t] + backward[t] - total)
    return np.exp(forward + backward - total), two


@cache
def field() -> Field:
    return Field()


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches: the local part is the run before an @, as far as no match has taken it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in order of kind, then start."""
    found = list(emails(text))
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := q.lstrip("0")) < 4 and int(p or 0) < 256 for q in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def plausible(kind: str, text: str) -> bool:
    """What a span of the field must have at least."""
    if kind == "email":
        return "@" in text and "." in text
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and text.count(".") == 3 and all(len(q := p.lstrip("0")) < 4 and int(q or 0) < 256 for p in parts)
    digits = "".join(c for c in text if c.isascii() and c.isdigit())
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def field_spans(texts: list[str], model: Field) -> list[list[tuple[str, int, int]]]:
    """What the field finds in each text of a batch, marks at both ends left out."""
    islands, places = [], []
    for i, text in enumerate(texts):
        shapes = list(map(model.shape, text.split()))
        around = [PLAIN, *shapes, PLAIN]
        for run in islands_of(shapes):
            islands.append([model.unary(tuple(around[j : j + 3])) for j in run])
            places.append((i, run[0]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    spots: dict[int, list[tuple[int, int]]] = {}
    for (i, first), path in zip(places, model.decode(islands), strict=True):
        if not any(path):
            continue
        if i not in spots:
            spots[i] = [m.span() for m in WORD.finditer(texts[i])]
        j = 0
        while j < len(path):
            k = j + 1
            while k < len(path) and path[k] == path[j]:
                k += 1
            if path[j]:
                a, b = spots[i][first + j][0], spots[i][first + k - 1][1]
                inner = texts[i][a:b]
                a += len(inner) - len(inner.lstrip(",;:!?\"'|"))
                b -= len(inner) - len(inner.rstrip(",.;:!?\"'|"))
                if plausible(LABELS[path[j]], texts[i][a:b]):
                    out[i].append((LABELS[path[j]], a, b))
            j = k
    return out


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``all``: arrays of (kind, start, end), one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
    model = docs.sparkSession.sparkContext.broadcast(field())  # trained once; its size is that of EXAMPLES

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        base, every = [], []
        for text, more in zip(texts, field_spans(texts, model.value), strict=True):
            first = base_spans(text)
            taken = Taken((a, b) for _, a, b in first)
            more = [s for s in more if not taken.overlaps(*s[1:])]
            base.append(as_rows(first))
            every.append(as_rows(sorted(first + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], ["doc_id", "base", "all"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, base {spans}, all {spans}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    counts = [count_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"))
