"""Secret scans: all rules in one byte pass of a combined minimal automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .automata import Dfa, Scanner
from .common import documents, slices, text_buffer

#: Text that one scan reads side by side.
SCAN_BYTES = 6 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a head, then the longest run of the tail; matches whose tail is under `least` bytes are dropped.

    `seen` is what the combined automaton looks for, if that may be narrower than head and tail without losing a match.
    """

    kind: str
    head: bytes
    tail: bytes
    least: int
    seen: bytes | None = None


def either_case(word: str) -> bytes:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word).encode()


_KEYS = b"|".join(map(either_case, ("password", "passwd", "secret", "token", "api"))).replace(either_case("api"), either_case("api") + b"_?" + either_case("key"))
#: Base kinds come first, in this order.
BASE = (
    Rule("assign", b"(" + _KEYS + rb""")["']?\x20*[:=]\x20*["']?""", rb"[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", b"AKIA", b"[A-Z0-9]+", 16),
    Rule("hex", b"", b"[0-9a-f]+", 24, b"[0-9a-f]{24}"),
)
MORE = (
    Rule("forge", b"gh[opsur]_", b"[A-Za-z0-9]+", 30),
    Rule("chat", b"xox[abprs]-", b"[A-Za-z0-9-]+", 16),
    Rule("jwt", b"eyJ", b"[A-Za-z0-9_.-]+", 40),
    Rule("pem", b"-----BEGIN [A-Z ]*PRIVATE KEY", b"-----", 5),
)


class SecretScanner:
    """Spans of every rule: leftmost, longest and not overlapping within a kind."""

    _made: dict[tuple[Rule, ...], SecretScanner] = {}

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> SecretScanner:
        """Compiled once a worker process."""
        if rules not in cls._made:
            cls._made[rules] = cls(rules)
        return cls._made[rules]

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.combined = Scanner([r.seen or r.head + r.tail for r in rules])
        self.heads = [Dfa([r.head], anywhere=False) for r in rules]
        self.tails = [Dfa([r.tail], anywhere=False) for r in rules]
        self.begins = [frozenset(b for b in range(256) if not h._lists()[2][h.table[0, b]]) if r.head else frozenset(b for b in range(256) if t.accepts[t.table[0, b]]) for r, h, t in zip(rules, self.heads, self.tails, strict=True)]

    def matches(self, rule: int, data: bytes) -> list[tuple[int, int]]:
        out, at, n = [], 0, len(data)
        head, tail, begins, least = self.heads[rule], self.tails[rule], self.begins[rule], self.rules[rule].least
        while at < n:
            if data[at] in begins and (mid := head.longest(data, at, n)) >= 0 and (end := tail.longest(data, mid, n)) > mid:
                if end - mid >= least:
                    out.append((at, end))
                at = end
            else:
                at += 1
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text, its spans (start, rule, end) in code points, in order."""
        buf, offsets = text_buffer(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        starts, ends, bits = self.combined.scan(buf, offsets)
        if not len(starts):
            return out
        before = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points that begin before each byte
        rows = np.searchsorted(offsets, starts, side="right") - 1
        found = []
        for row, a, b, rules in zip(rows.tolist(), starts.tolist(), ends.tolist(), bits.tolist(), strict=True):
            data = buf[a:b].tobytes()
            for r in range(len(self.rules)):
                found += [(row, a + s, r, a + e) for s, e in self.matches(r, data)] if rules >> r & 1 else ()
        if found:
            row, s, r, e = np.array(found).T
            base = before[offsets[row]]
            for i, span in zip(row.tolist(), zip((before[s] - base).tolist(), r.tolist(), (before[e] - base).tolist(), strict=True), strict=True):
                out[i].append(span)
        for spans in out:
            spans.sort()
        return out


def secret_spans(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined).

    Offsets are code points, ends exclusive; spans are ordered by start, then by kind as listed. base_sha256 is of the base
    kinds' spans alone; more kinds only add to spans. Null and empty texts have none. Rows, also ones that repeat or have no
    id, are judged each and keep their partition; an empty table gives no rows. The time is in proportion to a text's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = (*BASE, *more)
        scanner = SecretScanner.of(rules)
        for batch in batches:
            for part in slices(batch, limit=SCAN_BYTES):
                rows = scanner.scan(part.column("text"))
                told = [[(r, f"{rules[r].kind}:{a}:{b}") for a, r, b in spans] for spans in rows]
                counts = [pa.array([sum(r == k for r, _ in t) for t in told], pa.int64()) for k in range(len(BASE))]
                shas = [hashlib.sha256(",".join(x for r, x in t if r < len(BASE)).encode()).hexdigest() for t in told]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(shas), pa.array([",".join(x for _, x in t) for t in told])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
