"""Periodic runs: maximal stretches of words that repeat with some period, found and collapsed.

A suffix automaton reads a text word by word. Its suffix links form a tree, kept as a link-cut tree whose preferred
paths each hold states of one colour: where their substrings ended last. Access to the state of the newest prefix
recolours its path; each segment of the old paths says that suffixes of up to some length (``seen``) ended last at an
earlier place. If that place is no further back than ``seen``, the two occurrences touch or overlap: a square, whose
period is the distance. It is extended both ways to a run, once for each run.

Why the period found is the smallest: a shorter one would divide it, and the suffix would have ended nearer.

Long stretches of text cannot take part in a run and need no automaton (``stretches``): inside a run of period q, after
its first q words, every ``gram`` consecutive words stand q places earlier too, and that for many places in
a row. Only stretches where such repeats are that dense, with the words that they repeat, go to the automaton. The
condition is necessary, so that no run is lost; ``prune=False`` leaves it out, with the same runs.

Defined results: null, empty and blank texts have no words and no runs; repeated rows get equal results; a period
counts if the whole stretch has no smaller one; ids play no part; other columns are left alone; an empty table gives no rows.

Scale: one narrow pass without a shuffle. A text is held by one task, with some 500 bytes for each word that goes to
the automaton; batches of texts are worked off text by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, words_of

#: Words compared at once where repeats are looked for, and rounds of narrowing stretches down.
GRAM, ROUNDS = 3, 6
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def squares(words: Sequence[int], times: int = 2) -> Iterator[tuple[int, int, int]]:
    """(end, period, seen): the suffix of ``seen`` words that ends at ``end`` ended last ``period`` words before, which is
    at most ``seen / (times - 1)``. Of several suffixes with the same distance the longest is given.
    """
    # state 1 is the root, 0 none; ``up`` is the parent in a splay tree or, at its root, the state above the whole path
    length, link, steps = [0, 0], [0, 0], [{}, {}]
    up, left, right, last = [0, 0], [0, 0], [0, 0], [-1, -1]  # ``last`` counts at the roots of splay trees

    def rotate(x: int) -> None:
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            moved = left[y] = right[x]
            right[x] = y
        else:
            moved = right[y] = left[x]
            left[x] = y
        up[moved], up[y], up[x] = y, x, z

    def splay(x: int) -> None:
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                last[x] = last[z]
                rotate(y if (left[y] == x) == (left[z] == y) else x)
            else:
                last[x] = last[y]
            rotate(x)
            y = up[x]

    def state(size: int, above: int, following: dict) -> int:
        length.append(size)
        link.append(above)
        steps.append(following)
        for column, value in ((up, above), (left, 0), (right, 0), (last, -1)):
            column.append(value)
        return len(length) - 1

    tip, factor = 1, times - 1
    for end, word in enumerate(words):
        new, p = state(length[tip] + 1, 1, {}), tip
        while p and word not in steps[p]:
            steps[p][word] = new
            p = link[p]
        if p:
            q = steps[p][word]
            if length[q] != length[p] + 1:
                # a copy of q stands in above it, on the same path and with the same last end
                splay(q)
                copy = state(length[p] + 1, link[q], dict(steps[q]))
                up[copy], left[copy], right[copy], last[copy] = up[q], left[q], q, last[q]
                up[left[q]], left[q], up[q], link[q] = copy, 0, copy, copy
                while p and steps[p].get(word) == q:
                    steps[p][word] = copy
                    p = link[p]
                q = copy
            link[new] = up[new] = q
        below, u = 0, new
        while u:
            splay(u)
            before = last[u]
            if before >= 0 and (end - before) * factor <= length[u]:
                yield end, end - before, length[u]
            last[right[u]] = before  # what hangs deeper keeps its colour
            right[u] = below
            below, u = u, up[u]
        last[below] = end
        splay(new)
        tip = new


def stretches(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(begin, end) of stretches of words such that every run lies inside one of them."""
    spare = min(max(least, times * q) - q for q in range(1, least + 1))  # words of a run after its first period, at least
    gram = min(GRAM, spare)
    n = len(ids) - gram + 1
    if n < 2:
        return []
    keys = ids[:n].astype(np.uint64)
    for i in range(1, gram):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[i : n + i].astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    back = np.full(n, n, np.int64)  # distance to the same words before
    back[order[same + 1]] = order[same + 1] - order[same]
    held = back < n
    begins = ends = widest = np.empty(0, np.int64)
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(held, prepend=False, append=False))
        begins, ends = edges[::2], edges[1::2]
        enough = ends - begins > spare - gram
        begins, ends = begins[enough], ends[enough]
        # of a run, (times - 1) * q - gram + 1 places at least lie in its stretch, and none repeats from further than q
        widest = (ends - begins + gram - 1) // (times - 1)
        reach = np.zeros(n + 1, np.int64)
        reach[begins] += widest
        reach[ends] -= widest
        near = held & (back <= np.cumsum(reach[:-1]))
        if (near == held).all():
            break
        held = near
    return [(max(0, b - w), e + gram - 1) for b, e, w in zip(begins.tolist(), ends.tolist(), widest.tolist())]


def runs_of(words: Sequence, least: int = 6, times: int = 4, prune: bool = True) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``times`` periods, by start and period."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    found, latest = set(), {}
    for begin, stop in stretches(np.array(ids, np.int64), least, times) if prune else [(0, len(ids))]:
        for at, period, seen in squares(ids[begin:stop], times):
            start, end = begin + at - seen - period + 1, begin + at
            known = latest.get(period)
            if known and known[0] <= start and end <= known[1]:
                continue
            while end + 1 < len(ids) and ids[end + 1] == ids[end + 1 - period]:
                end += 1
            while start and ids[start - 1] == ids[start - 1 + period]:
                start -= 1
            latest[period] = start, end
            if end - start + 1 >= max(least, times * period):
                found.add((start, end - start + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > at:
            kept += words[at : max(at, begin)]
            at = end
    return b" ".join(kept + words[at:])


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 6, times: int = 4) -> DataFrame:
    """A row for each document: doc_id, n_words, runs (start, length and period in words, by start and period) and the collapsed text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))

    def search(batches):
        for batch in batches:
            counts, offsets, runs, kept = [], [0], [], []
            for raw in batch.column("raw"):
                words = words_of(raw.as_py())
                found = runs_of(words, least, times)
                counts.append(len(words))
                runs += found
                offsets.append(len(runs))
                kept.append(collapsed(words, found))
            columns = [pa.array(c, pa.int64()) for c in (zip(*runs) if runs else ([], [], []))]
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<{RUN}>, collapsed string")


def longest_run(runs: Column) -> Column:
    """The longest of an array of runs (ties: smallest start, then period), else null."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    return F.when(F.size(runs) > 0, F.struct((-ranked["back"]).alias("start"), ranked["length"].alias("length"), (-ranked["short"]).alias("period")))


def listed_runs(runs: Column) -> Column:
    """One line ``start,length,period`` for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")


def with_period(text: Column, begin: Column, period: Column) -> Column:
    """``text`` whose words from number ``begin`` on repeat its ``period`` words that begin there."""
    given = F.struct(F.regexp_extract_all(text, F.lit(WORD_REGEX), F.lit(0)).alias("words"), begin.alias("begin"), period.alias("period"))
    source = lambda g, i: (g["begin"] + (i - g["begin"]) % g["period"]).cast("int")
    # a lambda's variable, so that the text is not cut again for each word
    turned = lambda g: F.transform(g["words"], lambda w, i: F.when(i < g["begin"], w).otherwise(F.get(g["words"], source(g, i))))
    return F.array_join(F.transform(F.array(given), turned)[0], " ")
