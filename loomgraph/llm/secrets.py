"""Secret scans: all rules in one pass over the bytes of a text.

What every match must contain is, for all rules, one deterministic automaton that may begin anywhere. A run of
texts is cut after bytes that bring every state back to the start, so that no match crosses a cut; the
pieces then step through the transition array side by side. A piece in which some rule ends is walked
again by that rule's own anchored automaton, which gives the spans: leftmost, longest, not overlapping
within a kind, and dropped if the part that has a least length is shorter. Rules of several lines look for their
beginning and are walked on across cuts, up to the end of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .common import id_text, tidy
from .textkernel import Run, runs


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # of the whole match
    seen: str  # what every match long enough contains: short counts, as they multiply in the joint automaton
    least: int  # least bytes of the match after what prefix matches
    prefix: str | None = None
    lines: bool = False  # matches may go on beyond a cut


_MARKER = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
# line ends may be written as escapes, as in JSON
_NL = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_HEADER = r"[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*"
#: What follows a key's marker: headers and base64 with white space, quotes and the like, up to the END marker; where
#: there is none, the lines of base64 after it.
_KEY = (
    rf"(?:(?:(?:{_NL}|[ \t]+){_HEADER})*(?:[A-Za-z0-9+/=\s\\\"',>|])*-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"
    rf"|(?:{_NL}{_HEADER})*(?:{_NL})+[A-Za-z0-9+/]{{16,}}={{0,2}}(?:{_NL}[A-Za-z0-9+/]{{16,}}={{0,2}})*(?:{_NL}[A-Za-z0-9+/]{{1,15}}={{0,2}})?)?"
)

#: Base kinds first, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", 8, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 16),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{20}", 32),
    Rule("private_key", _MARKER + _KEY, _MARKER, 27, lines=True),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ", 30),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]", 15),
)
BASE = ("assign", "access", "hex")
#: A piece goes on to the first cut after so many bytes.
PIECE = 768
#: Fewer pieces than this are quicker to walk byte by byte than to step together.
FEW = 64
SPAN = "array<struct<kind string, start int, end int>>"


@lru_cache(maxsize=4)
def _machines(rules: tuple[Rule, ...]) -> tuple[Automaton, np.ndarray, list[tuple[list[bytes], list[int], list[bool]]], list]:
    scan = compile_rules([r.seen for r in rules], anywhere=True)
    return scan, scan.resets(), [_walkable(compile_rules([r.pattern], anywhere=False)) for r in rules], [_walkable(compile_rules([r.prefix], anywhere=False)) if r.prefix else None for r in rules]


def _walkable(a: Automaton) -> tuple[list[list[int]], list[bool], list[bool]]:
    """Per state its next state by byte (-1: dead) and whether the rule ends there, as plain lists."""
    t = a.step.reshape(-1, a.classes)[:, a.class_of].copy()
    t[a.dead[t]] = -1
    return t.tolist(), (a.accepts != 0).tolist(), [x >= 0 for x in t[0].tolist()]


def _longest(machine, raw: bytes, at: int, end: int) -> int:
    step, ends, _ = machine
    state, last = 0, -1
    while at < end:
        state = step[state][raw[at]]
        if state < 0:
            break
        at += 1
        if ends[state]:
            last = at
    return last


def pieces(run: Run, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the pieces: whole texts cut after reset bytes, each about PIECE long."""
    cut = np.flatnonzero(resets[run.raw]) + 1
    n = len(run.raw)
    # of the cuts, the first beyond each multiple of PIECE
    wanted = np.arange(PIECE, n, PIECE)
    at = np.searchsorted(cut, wanted)
    chosen = cut[at[at < len(cut)]]
    marks = np.unique(np.concatenate([run.borders, chosen]))
    starts, ends = marks[:-1], marks[1:]
    return starts, ends, np.searchsorted(run.borders, starts, "right") - 1


@lru_cache(maxsize=4)
def _rows_of(scan: Automaton) -> tuple[list[list[int]], list[int]]:
    """Per state its next state by byte, and the rules that end there."""
    return scan.step.reshape(-1, scan.classes)[:, scan.class_of].tolist(), scan.accepts.tolist()


def hits(scan: Automaton, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of the rules that end somewhere in each piece, all pieces stepping together; the last FEW that still run go on one by one."""
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that those still running lead
    begin, length = starts[order], (ends - starts)[order]
    state = np.zeros(len(order), np.int32)
    found = np.zeros(len(order), np.int64)
    klass, step, width, accepts = scan.class_of[raw], scan.step, np.int32(scan.classes), scan.accepts
    running = len(order) - np.searchsorted(length[::-1], np.arange(int(length[0]) if len(order) else 0), "right")
    for j, k in enumerate(running.tolist()):
        if k < FEW:
            rows, bits = _rows_of(scan)
            for x in range(k):
                at = int(begin[x]) + j
                s, seen = int(state[x]), int(found[x])
                for b in raw[at : at + int(length[x]) - j].tobytes():
                    s = rows[s][b]
                    if bits[s]:
                        seen |= bits[s]
                found[x] = seen
            break
        s = step[state[:k] * width + klass[begin[:k] + j]]
        state[:k] = s
        found[:k] |= accepts[s]
    out = np.zeros(len(order), np.int64)
    out[order] = found
    return out


def spans_of(raw: bytes, start: int, end: int, r: int, rules: tuple[Rule, ...], last_end: int | None = None) -> Iterator[tuple[int, int]]:
    """Spans of rule r that begin within bytes start .. end and end by last_end (end if None), as byte offsets."""
    _, _, whole, prefix = _machines(rules)
    machine, rule = whole[r], rules[r]
    first = machine[2]
    at = start
    while at < end:
        if not first[raw[at]]:
            at += 1
            continue
        last = _longest(machine, raw, at, end if last_end is None else last_end)
        if last < 0:
            at += 1
            continue
        skip = _longest(prefix[r], raw, at, last) - at if prefix[r] else 0
        if last - at - skip >= rule.least:
            yield at, last
        at = last


def _found(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, resets, _, _ = _machines(rules)
        for batch in batches:
            for r in runs(batch.column(1)):
                n = len(r.borders) - 1
                starts, ends, text = pieces(r, resets)
                bits = hits(scan, r.raw, starts, ends)
                spans: list[list[dict]] = [[] for _ in range(n)]
                whose, beyond, full = -1, [], (-1, b"")
                for i in np.flatnonzero(bits):
                    t, a, b = int(text[i]), int(starts[i]), int(ends[i])
                    raw = r.raw[a:b].tobytes()
                    head = None
                    if t != whose:
                        whose, beyond = t, [0] * len(rules)  # where each rule's last match ends
                    for k in range(len(rules)):
                        if bits[i] >> k & 1:
                            if rules[k].lines:
                                first = int(r.borders[t])
                                if full[0] != t:
                                    full = t, r.raw[first : r.borders[t + 1]].tobytes()
                                found = [(x + first - a, y + first - a) for x, y in spans_of(full[1], max(a - first, beyond[k]), b - first, k, rules, len(full[1]))]
                                beyond[k] = max([beyond[k], *(y + a - first for _, y in found)])
                            else:
                                found = spans_of(raw, 0, b - a, k, rules)
                            for x, y in found:
                                if head is None:
                                    head = _points(r.raw[r.borders[t] : a])
                                u = head + _points(r.raw[a : a + x])
                                spans[t].append({"kind": rules[k].kind, "start": u, "end": u + (_points(r.raw[a + x : a + y]) if rules[k].lines else y - x), "rank": k})
                for x in spans:
                    x.sort(key=lambda s: (s["start"], s["rank"]))
                yield pa.record_batch({"doc_id": batch.column(0).slice(r.first, n), "text": batch.column(1).slice(r.first, n), "spans": pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))})

    return run


def _points(raw: np.ndarray) -> int:
    return int(len(raw) - ((raw & 0xC0) == 0x80).sum())


def _reported(rules: tuple[Rule, ...]):
    inner = _found(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in inner(batches):
            yield x.select(["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every row, by start, then kind
    in rule order. Null and empty texts have no spans; repeated rows come repeated; null doc_ids stay
    null; extra columns are left out; an empty table gives no rows."""
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_reported(rules)), f"doc_id long, spans {SPAN}")


def redact(text: str, spans: list[dict], mark: str = "[{}]") -> str:
    """text with every span, overlapping ones as one, replaced by the kind of its first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark.format(s["kind"])]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def _redacted(rules: tuple[Rule, ...]):
    inner = _found(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            texts = batch.column(at)
            rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), texts], ["doc_id", "text"])
            new = texts.to_pylist()
            for x in inner(iter([rows])):
                for i, spans in zip(x.column("doc_id").to_pylist(), x.column("spans").to_pylist()):
                    if spans:
                        new[i] = redact(new[i], spans)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    return run


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in its text column replaced by the kind in brackets; texts without any stay
    as they are, null included, and so do all other columns (but n_chars, where there is one, follows)."""
    d = docs.withColumn("text", F.col("text").cast("string"))
    out = d.mapInArrow(tidy(_redacted(rules)), d.schema)
    return out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType)) if "n_chars" in d.columns else out


def span_digest(spans: list[dict]) -> str:
    return hashlib.sha256(",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans).encode()).hexdigest()
