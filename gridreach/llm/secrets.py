"""Secret scans: fixed patterns, and a guess-cost dynamic programme for values in a credential context.

The programme cuts a value into words, dates, repeats, keyboard walks and brute-force spans so that the product of
the guesses for the parts is least.  A value that even so takes 10^`strong` guesses or more is a secret.  Only ends that some
cut reaches below that bound are followed, so the work is linear in the value's length, whatever it holds.

Word guesses are ranks: COMMON parts of passwords first, then, with `fit_lexicon`, the words of the corpus by their number of occurrences.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.llm.text import keyed, over_batches, raw
from gridreach.session import cut

# The base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

# Names that announce a credential, and the user part of a URL.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret|signing)[_-]?key|credentials?|authorization|auth)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:bearer[\x20]+|basic[\x20]+)?["']?([^\s"'<>,;]{6,})"""
    r"""|://[^\s/@:"'<>]{1,64}:([^\s/@"'<>]{6,})@""",
    re.I | re.A,
)

# Common parts of passwords, the most common first.
COMMON = """password admin welcome letmein login master hello monkey dragon football baseball iloveyou sunshine princess shadow
superman batman trustno freedom whatever michael jordan ashley daniel jennifer summer winter spring autumn secret root user guest
test demo default changeme example sample token access private public server database oracle mysql manager office company love
pass word key api the and for you qwerty azerty computer internet network system service account money happy flower cookie cheese
pepper ginger silver golden purple orange yellow black white green blue star angel baby king queen prince soccer hockey tiger
lucky magic ninja hunter killer biteme matrix phoenix mustang harley corvette mercedes ferrari london paris berlin madrid
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december""".split()
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)", re.A)

LONGEST = 24
#: Letters only, a-z; everything else parts words of the corpus.  Word counts that a scan task holds.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
_HELD = 1 << 17


class Lexicon(dict):
    """Word ranks, and for each three-letter head the longest word that begins with it."""

    def __init__(self, ranks: Mapping[str, int]) -> None:
        super().__init__(ranks)
        self.heads: dict[str, int] = {}
        for w in self:
            self.heads[w[:3]] = max(self.heads.get(w[:3], 0), min(LONGEST, len(w)))

    def __reduce__(self):
        return Lexicon, (dict(self),)


LEXICON = Lexicon({w: i + 1 for i, w in enumerate(COMMON)})


def fit_lexicon(docs: DataFrame, top: int = 20_000) -> Lexicon:
    """COMMON, then the `top` most frequent corpus words of 3 to LONGEST letters (a-z, lower-cased), ranked by count, ties by the word.

    All texts are counted; words below the count that `top` words reach are left out before the ranks come to the driver.  Null and empty texts have no word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in raw(batch, "text"):
                seen.update(w for w in (text or b"").translate(_LETTERS).split() if 3 <= len(w) <= LONGEST)
                if len(seen) >= _HELD:
                    yield out()
        if seen:
            yield out()

    words = cut(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    size = F.floor(F.log2("n") * 8).cast("int")
    level, held = 0, 0
    for r in words.groupBy(size.alias("b")).count().orderBy(F.desc("b")).collect():  # a few hundred rows at most
        level, held = r["b"], held + r["count"]
        if held >= top:
            break
    ranked = [r["word"] for r in words.where(size >= level).orderBy(F.col("n").desc(), "word").limit(top).collect()]
    ranks = dict(LEXICON)
    for w in ranked:
        ranks.setdefault(w, len(ranks) + 1)
    return Lexicon(ranks)


#: Neighbours of a key, and on which side they lie.
_NEXT: dict[str, dict[str, int]] = {}
for _row in KEY_ROWS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT.setdefault(_a, {}).setdefault(_b, 1)
        _NEXT.setdefault(_b, {}).setdefault(_a, -1)


def _char_cost(c: str) -> float:
    """log10 of the characters of its class."""
    return math.log10(10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _lower(v: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = v.lower()
    return low if len(low) == len(v) else "".join(c.lower() if len(c.lower()) == 1 else c for c in v)


class Value:
    """A value with what every place shares: lower case, look-alikes folded, and how far each repeat of 1 to 4 characters goes."""

    def __init__(self, v: str) -> None:
        self.v, self.low = v, _lower(v)
        self.leet = self.low.translate(LEET)
        self.same: list[Sequence[int]] = [self._same(unit) for unit in range(1, 5)]

    def _same(self, unit: int) -> Sequence[int]:
        """For each place the number of characters from it on that equal those `unit` places on."""
        n = len(self.v)
        if n <= 256:
            out = [0] * (n + 1)
            for i in range(n - unit - 1, -1, -1):
                out[i] = out[i + 1] + 1 if self.v[i] == self.v[i + unit] else 0
            return out
        code = np.frombuffer(self.v.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.arange(n + 1)
        stop = np.full(n + 1, n - unit, np.int64)
        stop[: n - unit] = np.where(code[: n - unit] == code[unit:], n - unit, at[: n - unit])
        return np.maximum(np.minimum.accumulate(stop[::-1])[::-1] - at, 0)


def parts(value: Value | str, i: int, lexicon: Mapping[str, int], room: float = math.inf) -> Iterator[tuple[int, float, str]]:
    """(end, log10 guesses, kind) of the cheap parts that begin at i; walks stop where they would cost more than `room`."""
    x = value if isinstance(value, Value) else Value(value)
    lex = lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
    v, low, n = x.v, x.low, len(x.v)
    longest = max(lex.heads.get(low[i : i + 3], 0), lex.heads.get(x.leet[i : i + 3], 0))
    for j in range(i + 3, min(n, i + longest) + 1):
        word = low[i:j]
        rank, extra = lex.get(word), 0.0
        if rank is None:
            rank, extra = lex.get(x.leet[i:j]), math.log10(2) * 2
        if rank:
            raised = sum(c != d for c, d in zip(v[i:j], word, strict=True))
            case = 0 if not raised else math.log10(2) if raised == j - i or (raised == 1 and v[i] != low[i]) else math.log10(math.comb(j - i, raised) + 1)
            yield j, math.log10(rank + 1) + extra + case, "word"
    if "0" <= v[i] <= "9" and (m := DATE.match(v, i)) and m.end() - i >= 4:
        yield m.end(), math.log10(200 if m.end() - i == 4 else 365 * 200), "date"
    for unit in range(1, 5):
        j = i + unit + int(x.same[unit - 1][i]) // unit * unit
        if j - i >= max(3, 2 * unit) and j <= n:
            yield j, sum(map(_char_cost, v[i : i + unit])) + math.log10((j - i) // unit), "repeat"
    j, turns, was = i + 1, 0, 0
    while j < n and (step := _NEXT.get(low[j - 1], {}).get(low[j], 0)):
        turns, was, j = turns + (step != was), step, j + 1
        if j - i >= 3:
            cost = math.log10(47 * (j - i)) + max(0, turns - 1) * math.log10(4)
            if cost > room:
                break
            yield j, cost, "walk"


def guess_cost(v: str, lexicon: Mapping[str, int] = LEXICON, enough: float = math.inf) -> float:
    """log10 of the guesses for v by the cheapest cut into parts, `enough` if every cut costs that or more.

    Each part beyond the first doubles the guesses, as the cutter has to be guessed too.  Ends are taken in order, and only those that
    cost less than `enough` lead on: a part of any length costs more than nothing, so a bounded number of ends does.
    """
    x, lex = Value(v), lexicon if isinstance(lexicon, Lexicon) else Lexicon(lexicon)
    best, ends = {0: 0.0}, [0]
    while ends:
        i = heapq.heappop(ends)
        if i == len(v):
            return min(best[i], enough)
        here = best[i] + (math.log10(2) if i else 0)
        options = [(i + 1, best[i] + _char_cost(v[i]))] + [(j, here + c) for j, c, _ in parts(x, i, lex, enough - here)]
        for j, c in options:
            if c < enough and c < best.get(j, math.inf):
                if j not in best:
                    heapq.heappush(ends, j)
                best[j] = c
        del best[i]
    return enough


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in code points, end exclusive, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guessed_spans(text: str, strong: float, lexicon: Mapping[str, int] = LEXICON) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in a credential context that are costly to guess."""
    out = []
    if ":" in text or "=" in text:
        for m in CONTEXT.finditer(text):
            a, z = m.span(1) if m[1] is not None else m.span(2)
            if guess_cost(text[a:z], lexicon, strong) >= strong:
                out.append((a, 3, z))
    return out


def spans_of(text: str, strong: float, lexicon: Mapping[str, int] = LEXICON) -> list[tuple[int, int, int]]:
    """Base spans and the guessed ones that lie in none of them."""
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], [0, *accumulate((z for _, _, z in base), max)]
    more = [x for x in guessed_spans(text, strong, lexicon) if reach[bisect_right(starts, x[0])] < x[2]]
    return sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def scan(docs: DataFrame, strong: float = 10.0, lexicon: Mapping[str, int] = LEXICON) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every document.

    A null text counts as empty: no span, the hash of the empty string.  A null id is carried along, repeated rows give
    repeated results, extra columns are ignored, an empty table gives an empty result.  Long values are cut to the end
    or until every cut is strong; nothing is read in part.
    """
    lexicon = Lexicon(lexicon)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = spans_of(t or "", strong, lexicon)
            base = [x for x in found if x[1] < 3]
            n = [sum(x[1] == k for x in found) for k in range(4)]
            rows.append((d, *n[:3], hashlib.sha256(written(base).encode()).hexdigest(), written(found), n[3]))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return over_batches(keyed(docs, "doc_id", "text"), one, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, strong: float = 10.0, mark: str = "[SECRET]", lexicon: Mapping[str, int] = LEXICON) -> DataFrame:
    """The documents, all columns kept, with each secret in `text` replaced by `mark` and n_chars, where present, counted anew.

    Of an assignment only the value goes.  Overlapping secrets become one mark; a null text stays null.  Null ids and repeated rows are
    carried along, an empty table gives an empty result.
    """
    lexicon = Lexicon(lexicon)
    counted = "n_chars" in docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        found = spans_of(text, strong, lexicon)
        if not found:
            return text
        values = sorted((a + ASSIGN.match(text, a, z).start(2) - a if k == 0 else a, z) for a, k, z in found)
        out, at = [], 0
        for a, z in values:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, z)
        return "".join(out) + text[at:]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        was = batch.column("text").to_pylist()
        now = [clean(t) for t in was]
        names = batch.schema.names
        cols = [batch.column(i) for i in range(len(names))]
        cols[names.index("text")] = pa.array(now, batch.schema.field("text").type)
        if counted:
            i = names.index("n_chars")
            cols[i] = pa.array([x if a == b else len(b) for x, a, b in zip(cols[i].to_pylist(), was, now, strict=True)], cols[i].type)
        return pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(lambda batches: map(one, batches), docs.schema)
