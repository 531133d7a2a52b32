"""Learned decision lists over text statistics.

Statistics of every whole text come from one vectorised pass. From labelled ones, sequential covering
grows conjunctions of thresholds by information gain, prunes each on rows held back, and keeps those
that are precise there; the rows a rule covers leave before the next is grown. The list is emitted as
one ordered Spark conditional expression, so that applying it needs no model in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, tidy
from .textkernel import SAME, runs, windows

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_upper", "n_letters", "n_digits", "n_marks", "n_lines", "n_adjacent", "n_distinct_words"]
STATS = ", ".join(f"{x} long" for x in COUNTS)
#: What rules look at: ratios that do not grow with the text, all defined for empty texts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "adjacent_share": "n_adjacent / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "log_words": "ln(1 + n_words)",
}


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b"!?")
_LETTER = _UPPER | _table(bytes(range(97, 123)))
_CODE_POINT = np.ones(256, bool)
_CODE_POINT[0x80:0xC0] = False


def _per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[borders[1:]] - sums[borders[:-1]]


def duplicate_lines(lines: list[str]) -> int:
    seen: set[str] = set()
    n = 0
    for x in lines:
        if x in seen:
            n += 1
        elif x.strip("\t\n\x0b\x0c\r "):
            seen.add(x)
    return n


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for r in runs(texts):
            n = len(r.borders) - 1
            from_word = np.zeros(len(r.raw) + 1, np.int64)
            np.add.at(from_word, r.starts, 1)
            np.add.at(from_word, r.ends, -1)
            in_word = np.cumsum(from_word[:-1]) > 0
            out = {k: np.zeros(n, np.int64) for k in COUNTS}
            out["n_words"] = np.diff(r.word_at)
            out["word_chars"] = _per_text(in_word & _CODE_POINT[r.raw], r.borders)
            for k, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
                out[k] = _per_text(flags[r.raw], r.borders)
            words = r.hashes(SAME)
            eights = windows(words, 8)
            for i in range(n):
                lo, hi = r.word_at[i], r.word_at[i + 1]
                mine = words[lo:hi]
                out["n_distinct_words"][i] = len(np.unique(mine))
                out["n_adjacent"][i] = int((mine[1:] == mine[:-1]).sum())
                if hi - lo > 8:
                    own = eights[lo : hi - 7]
                    values, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
                    if len(values) < len(own):
                        again = np.flatnonzero(counts[inverse] > 1)
                        cover = np.zeros(hi - lo + 1, np.int64)
                        np.add.at(cover, again, 1)
                        np.add.at(cover, again + 8, -1)
                        out["n_repeat_words"][i] = int((np.cumsum(cover[:-1]) > 0).sum())
                lines = (texts[r.first + i].as_py() or "").split("\n")
                out["n_lines"][i] = len(lines)
                out["n_dup_lines"][i] = duplicate_lines(lines)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r.first, n), *(pa.array(out[k]) for k in COUNTS)], ["doc_id", *COUNTS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts in COUNTS for each row; null texts count as empty, every count 0 (one line).

    Words are runs of characters other than 0x20, 0x09-0x0D. Repeated rows come repeated; null doc_ids
    stay null; extra columns are left out; an empty table gives no rows.
    """
    return id_text(docs, id_col, text_col).mapInArrow(tidy(_stats), f"doc_id long, {STATS}")


@dataclass(frozen=True)
class Rule:
    """All of (feature, at_least, threshold) hold: verdict is bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, at_least, t in self.conditions:
            out &= x[name] >= t if at_least else x[name] < t
        return out

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[n]}) {'>=' if up else '<'} {t!r}D" for n, up, t in self.conditions)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain of covering p bad and n good rows where p0 and n0 were covered before."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    at = np.arange(len(bad))
    while len(conditions) < most and len(at) and not bad[at].all():
        p0, n0 = float(bad[at].sum()), float((~bad[at]).sum())
        best = (0.0, "", False, 0.0)
        for name, values in x.items():
            v = values[at]
            order = np.argsort(v, kind="stable")
            v, b = v[order], bad[at][order]
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cut):
                continue
            below_p, below_n = np.cumsum(b)[cut - 1], np.cumsum(~b)[cut - 1]
            for up, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                g = _gain(p.astype(float), n.astype(float), p0, n0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), name, up, float((v[cut[k] - 1] + v[cut[k]]) / 2))
        if not best[1]:
            break
        conditions.append(best[1:])
        v = x[best[1]][at]
        at = at[v >= best[3] if best[2] else v < best[3]]
    return Rule(tuple(conditions))


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    m = rule.mask(x)
    p, n = int((m & bad).sum()), int((m & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_conditions: int = 4, precision: float = 0.97, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, stop when a rule is no longer precise."""
    left = np.arange(len(bad))
    r = np.random.default_rng(seed)
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[left].sum() >= 10:
        order = r.permutation(left)
        grow, prune = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
        if not bad[grow].any():
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not rule.conditions:
            break
        held = {k: v[prune] for k, v in x.items()}
        options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        rule = max(options, key=lambda o: (_worth(o, held, bad[prune]), -len(o.conditions)))
        m = rule.mask(held)
        hits, misses = int((m & bad[prune]).sum()), int((m & ~bad[prune]).sum())
        if hits < 3 or hits < precision * (hits + misses):
            break
        rules.append(rule)
        left = left[~rule.mask({k: v[left] for k, v in x.items()})]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: null where no rule fires, else the rule's number."""
    out = F.lit(None).cast("int")
    if rules:
        case = F.when(F.expr(rules[0].sql()), F.lit(1))
        for k, rule in enumerate(rules[1:], 2):
            case = case.when(F.expr(rule.sql()), F.lit(k))
        out = case
    return out


def fit_rules(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: int = 1) -> list[Rule]:
    """Rules for label_col <> good, from at most most_rows labelled rows (the bound on what is collected).

    The rows are those with the least hash of their id, so that runs agree. Labels that are null or of
    ids without a text say nothing, and one given again says nothing new; without labels of both kinds there are no rules.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) != good).alias("bad")).where("doc_id is not null and bad is not null").distinct().orderBy(F.xxhash64("doc_id"), "bad").limit(most_rows)
    some = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    stats = text_statistics(some).join(F.broadcast(chosen), "doc_id").select(*(F.expr(sql).cast("double").alias(k) for k, sql in FEATURES.items()), "bad").toPandas()
    bad = stats["bad"].to_numpy(dtype=bool)
    if not len(bad) or bad.all() or not bad.any():
        return []
    order = np.lexsort([stats[k].to_numpy() for k in FEATURES])  # rows arrive in any order
    return learn_rules({k: stats[k].to_numpy()[order] for k in FEATURES}, bad[order])


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics of every row, base_failed (under 20 words, or over 30 % of words in repeated windows),
    rule (the first that fires) and kept."""
    stats = text_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
