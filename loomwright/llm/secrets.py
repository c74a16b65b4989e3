"""Secret spans: three exact patterns, and values in a credential context judged by their guess cost.

The guess cost of a value is the cheapest way to write it as dictionary words, dates, repeats, keyboard
walks and brute-force characters, in bits, found by dynamic programming over its positions. A value behind words such
as "passphrase" or "login", up to white space or its closing quote, is a secret if even the cheapest way is
expensive; "login: monday" is not. Addresses of mail name an account and are none.

The dictionary is a ranked list: the words below and, behind them, the words of a public tokenizer's vocabulary, which
is ordered by how common they are. The driver reads that file, which must be there, and broadcasts the list, of MOST_WORDS at most.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "guess")
#: Bits of guess cost from which a value in a credential context is a secret.
MIN_BITS = 38.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NOT_HEX = bytes(0 if chr(b) in "0123456789abcdef" else 1 for b in range(256))
_HEX_RUN = bytes(24)
_CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key",
    "access key", "access_key", "private key", "private_key", "credential", "login", "bearer",
)
_CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:" + "|".join(map(re.escape, _CONTEXT_WORDS)) + r")s?(?![A-Za-z])[\"']?(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}|\x20is:?\x20|\x20)(?:\"([^\"\s]{6,})|'([^'\s]{6,})|([^\s\"']\S{5,}))",
    re.IGNORECASE | re.ASCII,
)

_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.ASCII)

# Common parts of passwords, most common first (fixed values).
_WORDS = """
the and you that for with have this from they will would there their what about which when make can like time just know
take people into year your good some could them see other than then now look only come over think also back after use two
how our work first well way even new want because any these give day most password admin welcome login letmein monkey
dragon master sunshine princess football baseball shadow superman batman secret qwerty iloveyou hello freedom whatever
ninja mustang access flower summer winter spring autumn monday tuesday wednesday thursday friday saturday sunday january
february march april june july august september october november december love money computer internet test user root
guest default changeme token cheese pepper ginger soccer hockey killer tiger michael jennifer thomas robert daniel andrew
charlie maria database server example service system account public private key value name none null true false unknown
required incorrect invalid important expired protected protection security credentials credential username email address
authentication authorization authenticated information management generated generator generation classification
embedding embeddings sequence sequences prediction representation identifier configuration environment application
production development developer documentation function variable parameter parameters property settings provided because
between through without something everything nothing another different following available necessary possible
understanding recovery verification encryption encrypted algorithm manager storage strength changed reset missing
undefined optional placeholder string integer number https http www com org net html
""".split()
_RANK = {w: k + 1 for k, w in enumerate(dict.fromkeys(_WORDS))}
#: Vocabulary whose whole words follow those, in its order, on the driver.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MOST_WORDS = 50_000
_WORD_LENGTHS = (4, 20)
_LONGEST_WORD = max(map(len, _RANK))
# Characters that stand for letters (fixed values).
_LEET = str.maketrans({"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "l", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"})
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {pair for row in _ROWS for a, b in zip(row, row[1:], strict=False) for pair in (a + b, b + a)}
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)", re.ASCII)


def _brute_bits(c: str) -> float:
    if "0" <= c <= "9":
        return math.log2(10)
    if c.isascii():
        return math.log2(26) if c.isalpha() else math.log2(33)
    return math.log2(100)


class _Stretch:
    """Where stretches of three or more characters that end at some place may begin, as far as a beginning can still be the
    cheapest: the cost of a stretch is that of its beginning and the logarithm of its length."""

    def __init__(self) -> None:
        self.begin: list[tuple[int, float]] = []

    def add(self, start: int, bits: float) -> None:
        while self.begin and self.begin[-1][1] >= bits:  # an earlier beginning that isn't cheaper makes longer stretches of no less cost
            self.begin.pop()
        self.begin.append((start, bits))

    def cheapest(self, end: int) -> float:
        """Least cost at ``end``. A beginning dearer than an earlier one, and no better here, is no better at any later end."""
        best, kept = math.inf, []
        for start, bits in self.begin:
            cost = bits + math.log2(end - start)
            if cost < best:
                best = cost
                kept.append((start, bits))
        self.begin = kept
        return best


@lru_cache(maxsize=4)
def ranked_words(vocabulary: str | None = VOCABULARY) -> dict[str, int]:
    """Word -> rank, from one; the words of a vocabulary file are those it marks as ending a word. Without a name the words above are
    all; a file that is named and not there is an error."""
    ranks = dict(_RANK)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        fewest, most = _WORD_LENGTHS
        for token in sorted(ids, key=ids.get):
            word = token.removesuffix("</w>")
            if word != token and fewest <= len(word) <= most and word.isascii() and word.isalpha() and len(ranks) < MOST_WORDS:
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """Bits of the cheapest segmentation of the whole value, in time about linear in its length."""
    ranks = ranked_words() if ranks is None else ranks
    longest = max(_WORD_LENGTHS[1], _LONGEST_WORD)
    n, low = len(value), value.lower()
    if len(low) != n:  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    run_start, walk_start, runs, walks = 0, 0, _Stretch(), _Stretch()  # the repeat and the keyboard walk that end at i
    for i in range(1, n + 1):
        if i >= 2 and value[i - 1] != value[i - 2]:
            run_start, runs = i - 1, _Stretch()
        if i >= 2 and low[i - 2 : i] not in _NEXT:
            walk_start, walks = i - 1, _Stretch()
        cost = best[i - 1] + _brute_bits(value[i - 1])
        if i - run_start >= 3:  # one character, so often
            runs.add(i - 3, best[i - 3])
            cost = min(cost, runs.cheapest(i) + _brute_bits(value[i - 1]) + 1)
        if i - walk_start >= 3:  # where it starts, its direction and its length
            walks.add(i - 3, best[i - 3])
            cost = min(cost, walks.cheapest(i) + math.log2(47) + 2)
        for j in range(max(0, i - longest), i - 2):
            if rank := ranks.get(low[j:i]):
                cost = min(cost, best[j] + math.log2(rank) + (value[j:i] != low[j:i]) + 1)
            elif rank := ranks.get(plain[j:i]):
                cost = min(cost, best[j] + math.log2(rank) + (value[j:i] != low[j:i]) + 3)
        for m in (4, 8, 10):
            if i >= m and _DATE.fullmatch(value, i - m, i):
                cost = min(cost, best[i - m] + math.log2(120 * (365 if m > 4 else 1)) + (m == 10) * 2)
        for m in range(2, min(8, i // 2) + 1):  # a block once more
            if value[i - m : i] == value[i - 2 * m : i - m]:
                cost = min(cost, best[i - m] + math.log2(8) + 1)
        best[i] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost non-overlapping within each kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_NOT_HEX):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(spans)


def guessed_spans(text: str, base: list[tuple[int, int, int]], min_bits: float = MIN_BITS, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """Values in a credential context that cost ``min_bits`` or more and reach beyond every base span."""
    low = text.lower()
    if not any(w in low for w in _CONTEXT_WORDS):
        return []
    found, at = [], 0
    while m := _CONTEXT.search(text, at):
        start, end = m.span(m.lastindex)
        if m[3]:
            end = start + len(text[start:end].rstrip(".,;:?)]}>\"'"))
        if end - start >= 6 and not _MAIL.fullmatch(text, start, end) and guess_bits(text[start:end], ranks) >= min_bits and not any(s <= start and end <= e for s, _, e in base):
            found.append((start, 3, end))
            at = end
        else:
            at = start  # the value can be a context word itself
    return found


def spans_of(text: str | None, ranks: dict[str, int] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted by start, then kind."""
    base = base_spans(text or "")
    return base, sorted(base + guessed_spans(text or "", base, ranks=ranks))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, comma-joined by start and then by kind;
    ``base_sha256`` digests those of the three patterns alone. A null text counts as empty: no spans and the
    digest of the empty string. Repeated rows are all returned; an empty table gives an empty result.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(ranked_words(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                base, every = spans_of(text, ranks.value)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[secret]", ranks: dict[str, int] | None = None) -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s, _, e in spans_of(text, ranks)[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; all rows and columns stay."""
    names = docs.columns
    at = names.index("text")
    ranks = docs.sparkSession.sparkContext.broadcast(ranked_words(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([redact(x, ranks=ranks.value) for x in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
