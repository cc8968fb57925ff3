"""Operator 1, secret scans: all rules in one deterministic automaton, one pass over the bytes.

The rules' openings are compiled together (subset construction, minimisation, transition arrays); texts are cut at
bytes that no rule contains, and the pieces run through the automaton side by side. Only pieces that end in its
accepting state are looked at again, by one anchored automaton per rule, for exact spans.

Null and empty texts have no spans. Rows stay as they are, repeated or not; other columns are not read. Spans are in
code points, ordered by start, then by rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.llm import automaton
from tabularium.llm.common import slices, utf8

# The rules' patterns and least lengths.
KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]"


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives the matches; ``opening`` occurs in each that is long enough. ``least`` bytes are asked of a match,
    or of what follows its ``lead``."""

    kind: str
    pattern: str
    opening: str
    least: int
    lead: str = ""


RULES = (
    Rule("assign", KEYWORD + VALUE + "+", KEYWORD + VALUE, 12, KEYWORD),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 18),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{16}", 16),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


class Scanner:
    """Compiled rules; picklable arrays, built once per job."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = automaton.compile_patterns([r.opening for r in rules], search=True)
        self.each = [automaton.compile_patterns([r.pattern], search=False) for r in rules]
        self.leads = [automaton.compile_patterns([r.lead], search=False) if r.lead else None for r in rules]
        self.breaks = ~automaton.used_bytes([r.pattern for r in rules])

    def kept(self, k: int, piece: bytes) -> list[tuple[int, int]]:
        found = automaton.matches(self.each[k], piece)
        lead = self.leads[k]
        if lead is None:
            return [(a, b) for a, b in found if b - a >= self.rules[k].least]
        return [(a, b) for a, b in found if b - a - automaton.matches(lead, piece[a:b])[0][1] >= self.rules[k].least]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (start, rule, end) in code points of each text that has any."""
        starts = automaton.cut(data, offsets, self.breaks)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        hits = np.flatnonzero(self.all.accepts[automaton.run(self.all, data, starts, ends)])
        out: dict[int, list[tuple[int, int, int]]] = {}
        owner = np.searchsorted(offsets, starts[hits], side="right") - 1
        for h, doc in zip(hits, owner, strict=True):
            a = int(starts[h])
            piece = data[a:int(ends[h])].tobytes()
            for k in range(len(self.rules)):
                out.setdefault(int(doc), []).extend((a + x, k, a + y) for x, y in self.kept(k, piece))
        for doc, spans in list(out.items()):
            if not spans:
                del out[doc]
                continue
            base = int(offsets[doc])
            points = np.cumsum((data[base:int(offsets[doc + 1])] & 0xC0) != 0x80)
            at = lambda x: int(points[x - base - 1]) if x > base else 0
            out[doc] = sorted((at(x), k, at(y)) for x, k, y in spans)
        return out


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``df``: the key and its spans."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch):
                found = scanner.scan(*utf8(part.column("text")))
                spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in found.get(i, ())] for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, kind)], ["key", "spans"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kept = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(scan, f"key {kept}, spans {SPANS}").withColumnRenamed("key", key)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns; each stretch that spans cover is replaced by ``mark``. Null stays null."""
    scanner = Scanner(rules)

    def mend(value: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [value[at:a], mark]
            at = max(at, b)
        return "".join(out) + value[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                found = scanner.scan(*utf8(column))
                if found:
                    values = column.to_pylist()
                    for i, spans in found.items():
                        values[i] = mend(values[i], spans)
                    part = part.set_column(part.schema.get_field_index(text), text, pa.array(values, column.type))
                yield part

    return df.mapInArrow(scan, df.schema)
