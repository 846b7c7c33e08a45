"""Secrets in texts: three base patterns, and formats whose grammars are inferred from what these find.

1. One pass over the whole texts finds the base spans, the credentials in them (the value of an assignment, or the whole
   match), labelled with their kind, and the candidates: maximal runs of the characters of credentials,
   ``LEAST`` or longer, that touch no base span. Only these, not the texts, are written.
2. A bounded sample of the distinct credentials of each kind (the ``sample`` ones with the smallest hashes,
   of those of up to ``LONGEST`` characters) makes a prefix tree over classes of characters. States whose
   endings and continuations are statistically compatible (Hoeffding bounds, down the whole subtree)
   are merged, which leaves a probabilistic automaton. The candidates give one more, the background.
3. All candidates are scored, whole: the log-likelihood of their format under each kind's automaton against the
   background's. A span is added under the name of the best kind where the ratio is over ``MARGIN`` bits,
   and its likelihood per character is at least that of the kind's own credentials (all but the least
   ``TAIL`` of them). The scores depend on distinct values only, so copies in any number change nothing.

Offsets count code points. A null text is empty. Rows that are equal or share a doc_id are scanned each for
itself; a kind without ``FEWEST`` credentials to learn from adds none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written

#: The base kinds in their order; the fourth rank is the background.
KINDS = ("assign", "access", "hex")
BACKGROUND = len(KINDS)
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A maximal run is long enough or isn't a match at all, so these find what ``+`` and a check of the length would.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Candidates have so many characters at least.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST},}}")
#: Classes of characters, each of which is as likely as the others of its class.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
CLASS_OF = {c: i for i, own in enumerate(CLASSES) for c in own}
BITS_OF = [math.log2(len(own)) for own in CLASSES]
END = len(CLASSES)
SAMPLE, LONGEST, FEWEST = 1000, 128, 5
#: Significance of a difference between states; weight of what a state was never seen to do.
ALPHA, SMOOTH = 0.05, 0.1
MARGIN, TAIL = 10.0, 0.01


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
    """(start, rank, end) of the base matches in order, and their (rank, value)."""
    spans, values = [], []
    if ":" in text or "=" in text:
        for m in ASSIGN.finditer(text):
            if len(m.group(2)) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append((0, m.group(2)))
    for rank, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            spans.append((m.start(), rank, m.end()))
            values.append((rank, m.group()))
    return sorted(spans), values


def free_candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the candidates that touch no span."""
    out, at = [], 0
    ends = []  # the furthest end of the spans up to each
    for _, _, end in spans:
        ends.append(max(end, ends[-1] if ends else 0))
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            at += 1
        if not at or ends[at - 1] <= m.start():
            out.append((m.start(), m.end(), m.group()))
    return out


def joined(spans: Iterable[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    """kind:start:end of spans (start, rank, end), by start and rank."""
    return ",".join(f"{names[rank]}:{start}:{end}" for start, rank, end in sorted(spans))


_SPANS = "array<struct<start:int,rank:int,end:int>>"
_FOUND = f"n_assign long, n_access long, n_hex long, base_sha256 string, base {_SPANS}, labelled array<struct<rank:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>"


def found_column(text: Column) -> Column:
    """The base result of a text, its credentials and its candidates."""

    @F.pandas_udf(_FOUND)
    def of_batch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for value in texts:
            value = value or ""
            # none of the other patterns fits within words that are all short
            long = max(map(len, value.split()), default=0) >= LEAST
            if not long and ":" not in value and "=" not in value:
                out.append((0, 0, 0, hashlib.sha256(b"").hexdigest(), [], [], []))
                continue
            spans, labelled = base_spans(value)
            counts = [sum(rank == k for _, rank, _ in spans) for k in range(len(KINDS))]
            candidates = free_candidates(value, spans) if long else []
            out.append((*counts, hashlib.sha256(joined(spans, KINDS).encode()).hexdigest(), spans, labelled, candidates))
        names = [c.split()[0] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "labelled", "candidates")]
        frame = pd.DataFrame(out, columns=names)
        for name, fields in (("base", ("start", "rank", "end")), ("labelled", ("rank", "value")), ("candidates", ("start", "end", "value"))):
            frame[name] = [[dict(zip(fields, x, strict=True)) for x in row] for row in frame[name]]
        return frame

    return of_batch(text)


class Automaton:
    """A prefix tree of strings of classes, of which compatible states are merged."""

    def __init__(self, values: Iterable[str], alpha: float = ALPHA) -> None:
        self.arrived, self.ended, self.next = [0], [0], [{}]
        for value in values:
            self._add(value)
        self.reach = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self._settle()

    def _add(self, value: str) -> None:
        state = 0
        self.arrived[0] += 1
        for c in value:
            edge = self.next[state].setdefault(CLASS_OF[c], [len(self.next), 0])
            if edge[0] == len(self.next):
                self.arrived.append(0)
                self.ended.append(0)
                self.next.append({})
            edge[1] += 1
            state = edge[0]
            self.arrived[state] += 1
        self.ended[state] += 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.reach * (n**-0.5 + m**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        stack = [(red, blue)]
        while stack:
            r, b = stack.pop()
            n, m = self.arrived[r], self.arrived[b]
            if self._differ(self.ended[r], n, self.ended[b], m):
                return False
            for c in self.next[r].keys() | self.next[b].keys():
                one, two = self.next[r].get(c), self.next[b].get(c)
                if self._differ(one[1] if one else 0, n, two[1] if two else 0, m):
                    return False
                if one and two:
                    stack.append((one[0], two[0]))
        return True

    def _fold(self, red: int, blue: int) -> set[int]:
        """Add the tree below ``blue`` to ``red``; returns the states that have gained edges."""
        stack, gained = [(red, blue)], set()
        while stack:
            r, b = stack.pop()
            self.arrived[r] += self.arrived[b]
            self.ended[r] += self.ended[b]
            for c, (child, count) in self.next[b].items():
                edge = self.next[r].get(c)
                if edge is None:
                    self.next[r][c] = [child, count]
                    gained.add(r)
                else:
                    edge[1] += count
                    stack.append((edge[0], child))
        return gained

    def _merge_all(self) -> None:
        """Settle states, the first settled one's children first: a state joins the first settled one that it is compatible with, or is settled itself."""
        self.states = [0]
        place, due = {0: 0}, [0]
        while due:
            at = heapq.heappop(due)
            state = self.states[at]
            for c in sorted(self.next[state]):
                edge = self.next[state][c]
                blue = edge[0]
                if blue in place:
                    continue
                red = next((r for r in self.states if self._compatible(r, blue)), None)
                if red is None:
                    place[blue] = len(self.states)
                    self.states.append(blue)
                    heapq.heappush(due, place[blue])
                    continue
                edge[0] = red
                for touched in self._fold(red, blue) & place.keys():
                    heapq.heappush(due, place[touched])

    def _settle(self) -> None:
        """The automaton as tables: for each state and class, bits and the next state (the last one is lost)."""
        number = {s: i for i, s in enumerate(self.states)}
        lost, self.steps, self.ends = len(number), [], []
        for s in self.states:
            total = self.arrived[s] + SMOOTH * (len(CLASSES) + 1)
            row = []
            for c in range(len(CLASSES)):
                child, count = self.next[s].get(c, (None, 0))
                row.append((math.log2((count + SMOOTH) / total) - BITS_OF[c], number.get(child, lost)))
            self.steps.append(row)
            self.ends.append(math.log2((self.ended[s] + SMOOTH) / total))
        even = -math.log2(len(CLASSES) + 1)
        self.steps.append([(even - b, lost) for b in BITS_OF])
        self.ends.append(even)
        del self.arrived, self.ended, self.next

    def bits(self, value: str) -> float:
        """The logarithm of the probability of exactly this string."""
        state, total = 0, 0.0
        for c in value:
            bits, state = self.steps[state][CLASS_OF[c]]
            total += bits
        return total + self.ends[state]


class Grammars:
    """The automata of the kinds that have enough to learn from, and of the background."""

    def __init__(self, samples: dict[int, list[str]]) -> None:
        self.background = Automaton(samples.get(BACKGROUND, []))
        self.of, self.floors = {}, {}
        for rank in range(len(KINDS)):
            values = samples.get(rank, [])
            if len(values) >= FEWEST:
                own = Automaton(values)
                per = sorted(own.bits(v) / len(v) for v in values)
                self.of[rank], self.floors[rank] = own, per[int(TAIL * len(per))]

    def judged(self, value: str) -> tuple[int | None, float]:
        """The rank of the kind that the value is taken for (or none), and the best kind's bits over the background's."""
        bits = {rank: own.bits(value) for rank, own in self.of.items()}
        if not bits:
            return None, 0.0
        rank = max(bits, key=lambda r: (bits[r], -r))
        ratio = bits[rank] - self.background.bits(value)
        return (rank if ratio > MARGIN and bits[rank] / len(value) >= self.floors[rank] else None), ratio


def learned(found: DataFrame, sample: int = SAMPLE) -> Grammars:
    """Grammars from a sample of at most ``sample`` distinct values of each kind and of the background."""
    others = F.transform("candidates", lambda c: F.struct(F.lit(BACKGROUND).alias("rank"), c["value"].alias("value")))
    values = found.select(F.explode(F.concat("labelled", others)).alias("v")).select("v.*").filter(F.length("value") <= LONGEST)
    distinct = written(values.distinct(), "credentials")
    samples = {}
    for rank in range(len(KINDS) + 1):
        first = distinct.filter(F.col("rank") == rank).orderBy(F.xxhash64("value"), "value").limit(sample)
        samples[rank] = sorted(r["value"] for r in first.select("value").collect())
    return Grammars(samples)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all, joined), n_added and added (start, end, kind, value and bits of
    the spans of the method) of every row of ``docs``."""
    found = written(docs.select("doc_id", found_column(F.col("text")).alias("own")).select("doc_id", "own.*"), "found-secrets")
    grammars = learned(found, sample)
    names = (*KINDS, *(f"{k}-like" for k in KINDS))

    @F.pandas_udf("spans string, added array<struct<start:int,end:int,kind:string,value:string,bits:double>>")
    def scored(base: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        known, out = {}, []
        for own, more in zip(base, candidates, strict=True):
            spans, added = [(s["start"], s["rank"], s["end"]) for s in own], []
            for c in more:
                value = c["value"]
                if value not in known:
                    known[value] = grammars.judged(value)
                rank, bits = known[value]
                if rank is not None:
                    spans.append((c["start"], len(KINDS) + rank, c["end"]))
                    added.append({"start": c["start"], "end": c["end"], "kind": names[len(KINDS) + rank], "value": value, "bits": bits})
            out.append((joined(spans, names), added))
        return pd.DataFrame(out, columns=["spans", "added"])

    done = found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", scored("base", "candidates").alias("all"))
    return done.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "all.spans", F.size("all.added").cast("long").alias("n_added"), "all.added")
