"""Secret scans by grammar inference.

Credentials that plain patterns find in the corpus are the labelled examples. Of a bounded, documented sample of them a prefix
tree is built for each kind, over classes of characters, and its statistically compatible states are merged (Hoeffding bound) into
a probabilistic automaton. All further candidates are scored by how much likelier their format is under a kind's automaton than under that of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, sliced, with_text

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: The fit: so many labelled credentials of a kind and so many ordinary words at most (those of least hash, whole), in so many characters of a kind; values longer than the last number are no examples.
SAMPLE, SAMPLE_CHARS, LONGEST_EXAMPLE = 800, 200_000, 4096
#: Confidence parameter of the test for compatible states; log-likelihood ratio per character (in nats) from which a candidate is a secret.
ALPHA, LEAST_RATIO = 0.05, 0.3
#: What stands for a secret in a redacted text.
MASK = "[secret]"
#: Formats up to this length are remembered once scored.
SHORT = 200


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind's place in KINDS, end) in order: code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of start to end that no span covers, in order."""
    parts, at = [], start
    for a, _, b in sorted(spans):
        if at < min(a, end):
            parts.append((at, min(a, end)))
        at = max(at, b)
    return [*parts, (at, end)] if at < end else parts


CLASSES = {c: "h" if "a" <= c <= "f" else "l" if c.islower() else "U" if c.isupper() else "9" for c in string.ascii_letters + string.digits}


def format_of(value: str) -> str:
    """Classes of characters: a lower-case hexadecimal letter, another lower-case one, an upper-case one, a digit, or the character itself."""
    return "".join([CLASSES.get(c, c) for c in value])


class Automaton:
    """A deterministic probabilistic automaton: per state, counts of symbols (end: empty) and the next states. A symbol that a state has not seen leads to
    one state more, which stays where it is and has the counts of all symbols in all formats."""

    def __init__(self, formats: Counter):
        self.out: list[Counter] = [Counter()]
        self.to: list[dict[str, int]] = [{}]
        self.rest: Counter = Counter()
        for f, n in sorted(formats.items()):
            s = 0
            for c in f:
                self.out[s][c] += n
                if c not in self.to[s]:
                    self.to[s][c] = len(self.to)
                    self.to.append({})
                    self.out.append(Counter())
                s = self.to[s][c]
                self.rest[c] += n
            self.out[s][""] += n
            self.rest[""] += n
        self.merge()
        self.sums = [sum(c.values()) for c in (*self.out, self.rest)]

    def compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = sum(self.out[a].values()), sum(self.out[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.out[a][c] / n - self.out[b][c] / m) > bound for c in {*self.out[a], *self.out[b]}):
                return False
            stack += [(self.to[a][c], self.to[b][c]) for c in self.to[a] if c in self.to[b] and self.to[a][c] != self.to[b][c]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the subtree of b to the state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.out[a].update(self.out[b])
            for c, s in self.to[b].items():
                if c in self.to[a]:
                    stack.append((self.to[a][c], s))
                else:
                    self.to[a][c] = s

    def merge(self) -> None:
        """Red-blue order: each state next to a settled one joins the first settled one that it is compatible with, or is settled."""
        red, settled = [0], {0}
        while blue := [(r, c) for r in red for c in sorted(self.to[r]) if self.to[r][c] not in settled]:
            for parent, c in blue:
                s = self.to[parent][c]
                if s in settled:
                    continue
                mate = next((r for r in red if self.compatible(r, s)), None)
                if mate is None:
                    red.append(s)
                    settled.add(s)
                else:
                    self.to[parent][c] = mate
                    self.fold(mate, s)
        place = {s: i for i, s in enumerate(red)}
        self.out = [self.out[s] for s in red]
        self.to = [{c: place[t] for c, t in self.to[s].items()} for s in red]

    def log_likelihood(self, form: str) -> float:
        """Of the format and its end, per symbol, with a little mass on what no state has seen."""
        s, total = 0, 0.0
        for c in (*form, ""):
            seen = self.out[s] if s >= 0 else self.rest
            total += math.log((seen[c] + 0.05) / (self.sums[s] + 0.05 * 16))
            s = self.to[s].get(c, -1) if s >= 0 else -1
        return total / (len(form) + 1)


def least_hashed(values: dict[str, int]) -> dict[str, int]:
    """The SAMPLE values (to hashes) of least hash."""
    return dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:SAMPLE])


def fit(docs: DataFrame) -> dict[str, dict[str, int]]:
    """Counted formats by kind (word: ordinary words), from a bounded sample of each kind's credentials over all of docs.

    The sample takes the distinct (kind, value) pairs of least hash, so hot values or documents don't fill it and it is the same however docs is dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = {}
        for batch in sliced(batches):
            seen: set[tuple[str, str]] = set()
            for t in batch.column("text"):
                text = t.as_py() or ""
                base = spans_of(text)
                for m in ASSIGN.finditer(text):
                    if m.end(2) - m.start(2) >= 12:
                        seen.add(("assign", m[2]))
                seen |= {(KINDS[k], text[a:b]) for a, k, b in base if k}
                seen |= {("word", m[0]) for m in CANDIDATE.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b in base)}
            for kind, value in seen:
                if len(value) <= LONGEST_EXAMPLE:
                    best.setdefault(kind, {})[value] = hash_of(value) >> 1
            best = {k: v if len(v) <= 4 * SAMPLE else least_hashed(v) for k, v in best.items()}
        rows = [(k, v, h) for k, vs in best.items() for v, h in least_hashed(vs).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["kind", "value", "h"])

    values = docs.select("text").mapInArrow(run, "kind string, value string, h long").distinct()
    for part in (F.col("h") % 256, F.lit(0)):  # in parts first, so that no task meets all tasks' values
        first = Window.partitionBy("kind", part).orderBy("h", "value")
        values = values.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE)
    upto = F.sum(F.length("value")).over(Window.partitionBy("kind").orderBy("h", "value"))
    forms: dict[str, Counter] = {}
    for r in values.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).select("kind", "value").collect():  # SAMPLE of each of four kinds at most
        forms.setdefault(r["kind"], Counter())[format_of(r["value"])] += 1
    return {k: dict(v) for k, v in forms.items()}


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


class Model:
    """Automata of kinds, the least likelihood of a credential of each, and the automaton of ordinary words (without any: all symbols are as likely)."""

    def __init__(self, formats: dict[str, dict[str, int]]):
        self.automata = {k: Automaton(Counter(formats[k])) for k in KINDS if formats.get(k)}
        # a format must be as likely as the labelled credentials' own are, but for some slack
        self.least = {k: min(a.log_likelihood(f) for f in formats[k]) - 0.2 for k, a in self.automata.items()}
        self.ordinary = Automaton(Counter(formats.get("word")))

    def likely(self, form: str) -> bool:
        """Whether a format is likely under some kind's automaton, and likelier by the least ratio than under ordinary words'."""
        found = [x for k, a in self.automata.items() if (x := a.log_likelihood(form)) >= self.least[k]]
        return bool(found) and max(found) - self.ordinary.log_likelihood(form) >= LEAST_RATIO


class Scanner:
    def __init__(self, model: Model):
        self.model, self.known = model, lru_cache(1 << 16)(model.likely)

    def secret(self, form: str) -> bool:
        return self.known(form) if len(form) <= SHORT else self.model.likely(form)

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans and the method's further spans (kind 3), each in order; the latter don't touch the former."""
        text = text or ""
        base = spans_of(text)
        more = []
        for m in CANDIDATE.finditer(text):
            touching = [x for x in base if x[0] < m.end() and m.start() < x[2]]
            # a labelled value ends with its run, and what is before the label is no part of it
            for a, b in outside(m.start(), m.end(), [x for x in touching if x[1] == 0]):
                if b - a < 12:
                    continue
                parts = outside(a, b, touching)
                whole = self.secret(format_of(text[a:b]))
                more += [(c, 3, d) for c, d in parts if whole or 12 <= d - c < b - a and self.secret(format_of(text[c:d]))]
        return base, more


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'model')[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span, or run of spans that overlap, replaced by MASK."""
    parts, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            parts += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text


def scan(docs: DataFrame, formats: dict[str, dict[str, int]], keep: list[str] = ["doc_id"], *, redact: bool = False) -> DataFrame:  # noqa: B006
    """The columns in keep and base_spans, spans (kind:start:end, comma-joined by start, then kind), n_assign, n_access, n_hex and n_model of every row's whole text; with redact, also redacted (the text with MASK in the place of spans).

    A null text is empty and has no span. Texts of any length are scanned whole. Repeated rows give repeated results; docs needs a text column, others don't matter."""

    chosen, name = with_text(docs, keep)
    model = Model(formats)  # of bounded size, as its sample is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in sliced(batches):
            found = [scanner.scan(t.as_py()) for t in batch.column(name)]
            counts = [Counter(k for s in f for _, k, _ in s) for f in found]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(sorted(b + m)) for b, m in found], pa.string())]
            columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            names = [*keep, "base_spans", "spans", "n_assign", "n_access", "n_hex", "n_model"]
            if redact:
                columns.append(pa.array([redacted(t.as_py(), b + m) for t, (b, m) in zip(batch.column(name), found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(run, ddl(docs.select(*keep), "base_spans string, spans string, n_assign long, n_access long, n_hex long, n_model long" + ", redacted string" * redact))
