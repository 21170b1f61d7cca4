"""Substring dedup by seed and extend.

Seeds: every passage of ``length`` words is represented by the smallest hash among the word
``gram``-grams inside it (winnowing; of equal ones the first), so equal passages always share an
anchor at the same place, and few anchors are kept for a document. Anchors that occur in two
different documents are the seeds.

Extension: an occurrence of a seed carries its context, the words on either side that a passage
around it can reach. Occurrences that agree on the words of the anchor are extended to the left and
to the right, word by word; those that still agree stay in one class. Left and right extensions
that together make a passage of ``length`` words give a class whose smallest document id is kept,
and neighbouring passages with the same smallest id join to one maximal repeat. Words themselves
are compared, hashes only choose the seeds. A word of a repeat goes if that id is smaller than its
document's; repeats of neighbouring seeds overlap and their union is cut out.

Groups are never expanded into pairs: equal contexts collapse first, and classes hold smallest ids
only. Exact copies of a whole word sequence are settled by one digest before that, and only the one
with the smallest id takes part in the rest; so a hot group of copies costs one row each.

Defined results: null, empty and blank texts have no words; texts shorter than ``length`` lose
nothing; a passage repeated inside one document only is kept; rows with equal ids never remove
each other's words; a null id removes nothing and loses nothing; an empty table gives no rows;
other columns stay or are ignored.

Scale: anchors (about one for ``(length - gram) / 2`` words) and the contexts of seeds are shuffled,
the text twice by document. Contexts are dealt to tasks by anchor, about ``deal_rows`` each. An
anchor with more different contexts than that is extended by a shuffle instead: each of its
passages is a group of its own, named by a 128-bit hash, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpointed, fresh_name, release, rolling, store, words_of


def sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest of every run of ``width`` values, and the first place where it stands, by doubling."""
    if len(values) < width:
        return values[:0], np.empty(0, np.int64)
    places, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        right = values[step:] < values[:-step]
        values, places = np.where(right, values[step:], values[:-step]), np.where(right, places[step:], places[:-step])
        have += step
    return values, places


@dataclass
class Anchors:
    """Anchors of word lists, and the contexts in which they stand."""

    length: int
    gram: int
    known: WordHashes = field(default_factory=WordHashes)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each passage its anchor (signed) and the place of that."""
        if len(words) < self.length:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        values, places = sliding_min(rolling(self.known.of(words), self.gram), self.length - self.gram + 1)
        return values.view(np.int64), places

    def contexts(self, words: list[bytes], seeds: np.ndarray) -> dict[tuple[int, int, bytes], list[int]]:
        """Places of each (anchor, words before it in the context, context) whose anchor is a seed."""
        values, places = self.of(words)
        at, which = np.unique(places[np.isin(values, seeds)], return_index=True)
        reach, out = self.length - self.gram, {}
        for p, anchor in zip(at.tolist(), values[np.isin(values, seeds)][which].tolist()):
            start = max(0, p - reach)
            out.setdefault((anchor, p - start, b" ".join(words[start : p + self.length])), []).append(p)
        return out


def extend(anchor: np.ndarray, lead: np.ndarray, contexts: list[bytes], low: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each context and each number of words before the anchor (0 to ``length - gram``) the smallest ``low`` of
    the contexts that agree on the passage of ``length`` words beginning there; -1 where a context is too short.
    """
    n, reach = len(contexts), length - gram
    numbers: dict[bytes, int] = {}
    words = np.full((n, 2 * reach + gram), -1, np.int64)  # the anchor begins in column ``reach``
    for i, (context, before) in enumerate(zip(contexts, lead.tolist())):
        own = [numbers.setdefault(w, len(numbers)) for w in context.split(b" ")]
        words[i, reach - before : reach - before + len(own)] = own
    base = len(numbers) + 1

    def refined(classes: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.unique(classes * base + column + 1, return_inverse=True)[1]

    right = np.unique(anchor, return_inverse=True)[1]
    for j in range(gram):
        right = refined(right, words[:, reach + j])
    rights, lefts = [right], [np.zeros(n, np.int64)]
    for j in range(reach):
        rights.append(refined(rights[-1], words[:, reach + gram + j]))
        lefts.append(refined(lefts[-1], words[:, reach - 1 - j]))
    out = np.full((n, reach + 1), -1, np.int64)
    for before in range(reach + 1):
        whole = (words[:, reach - before] >= 0) & (words[:, reach - before + length - 1] >= 0)
        at = np.flatnonzero(whole)
        if not len(at):
            continue
        classes = np.unique(lefts[before][at] * (n + 1) + rights[reach - before][at], return_inverse=True)[1]
        least = np.full(classes.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, classes, low[at])
        out[at, before] = least[classes]
    return out


#: Most rows of a table of crowded anchors that is broadcast; above that the join is shuffled.
MOST_BROADCAST = 1_000_000


@dataclass
class Repeats:
    """rows: doc_id, h (hash of the text) and raw text of each row; profile: doc_id, h, n_words, whole (SHA-256 of
    the words); copies: doc_id and h of rows whose words all stand in a smaller document; spans: doc_id, h and
    the repeats to cut out (start and end in words)."""

    rows: DataFrame
    profile: DataFrame
    copies: DataFrame
    spans: DataFrame


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, gram: int = 16, deal_rows: int = 16_384, anchor_rows: int = 65_536) -> Repeats:
    """The repeats of ``docs``. Contexts are compared in deals of about ``deal_rows``; an anchor with more than a quarter of that is a deal of its
    own, and one with more than ``anchor_rows`` contexts is worked off passage by passage, whose rows are many but spread.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("binary").alias("raw"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            counts, wholes, found = [], [], []
            for raw in batch.column("raw").to_pylist():
                words = words_of(raw)
                counts.append(len(words))
                wholes.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(np.unique(anchors.of(words)[0]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(counts, pa.int64()), pa.array(wholes, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "h", "n_words", "whole", "anchors"],
            )

    scanned = checkpointed(keyed.mapInArrow(scan, f"doc_id {id_type}, h long, n_words long, whole binary, anchors array<long>"))
    profile = scanned.drop("anchors")
    long_enough = scanned.where((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    # what is joined is materialised, so that both sides are plain shuffles and Spark can split a hot key among tasks
    first = checkpointed(long_enough.groupBy("whole").agg(F.min("doc_id").alias("first_id")))
    settled = long_enough.join(first, "whole")
    copies = settled.where("doc_id > first_id").select("doc_id", "h").distinct()
    seeds = settled.where("doc_id = first_id").select("doc_id", "h", F.explode("anchors").alias("anchor"))
    shared = checkpointed(seeds.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("anchor"))
    marks = seeds.join(shared, "anchor").groupBy("doc_id", "h").agg(F.collect_set("anchor").alias("seeds"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            rows, keys, places = [], [], []
            for i, (raw, seeds_of) in enumerate(zip(batch.column("raw").to_pylist(), batch.column("seeds").to_pylist())):
                for key, at in anchors.contexts(words_of(raw), np.array(seeds_of, np.int64)).items():
                    rows.append(i)
                    keys.append(key)
                    places.append(at)
            take = pa.array(rows, pa.int64())
            digests = [xxhash.xxh3_128_digest(context) for _, _, context in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("h").take(take), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(digests, pa.binary()), pa.array([k[2] for k in keys], pa.binary()), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "h", "anchor", "lead", "name", "context", "places"],
            )

    met = keyed.join(marks, ["doc_id", "h"]).select("doc_id", "h", "raw", "seeds").mapInArrow(cut, f"doc_id {id_type}, h long, anchor long, lead int, name binary, context binary, places array<int>")
    met, met_path = store(met)
    key = ["anchor", "lead", "name"]
    contexts = met.groupBy(*key, "context").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    contexts, contexts_path = store(contexts)
    large = checkpointed(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > min(deal_rows // 4, anchor_rows)))
    crowded = large.where(F.col("n") > anchor_rows).select("anchor")
    found = f"anchor long, lead int, name binary, repeats array<struct<low: {id_type}, begin: int, finish: int>>"

    def refine(table: pa.Table) -> pa.Table:
        low, high = table.column("low"), table.column("high")
        ids, ranks = np.unique(np.array(low.to_pylist() + high.to_pylist()), return_inverse=True)
        low_rank, high_rank = ranks[: table.num_rows], ranks[table.num_rows :]
        least = extend(table.column("anchor").to_numpy(), table.column("lead").to_numpy(), table.column("context").to_pylist(), low_rank, length, gram)
        least = np.where((least >= 0) & (least < high_rank[:, None]), least, -1)
        # runs of neighbouring passages with the same smallest id are one repeat
        edge = np.pad(least[:, 1:] != least[:, :-1], ((0, 0), (1, 1)), constant_values=True)
        row, start = np.nonzero(edge[:, :-1] & (least >= 0))
        stop = np.nonzero(edge[:, 1:] & (least >= 0))[1]
        parts = [pa.array(ids[least[row, start]].tolist(), low.type), pa.array(-stop, pa.int32()), pa.array(length - start, pa.int32())]
        which, sizes = np.unique(row, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays(parts, names=["low", "begin", "finish"]))
        return pa.table([*(table.column(c).take(pa.array(which)) for c in key), lists], names=[*key, "repeats"])

    sized = contexts.join(F.broadcast(large) if large.count() <= MOST_BROADCAST else large, "anchor", "left")
    plain = sized.where(F.col("n").isNull() | (F.col("n") <= anchor_rows))
    deals = max(1, -(-contexts.count() // deal_rows))
    # a large anchor is a group by itself, so that no group grows by several of them
    dealt = plain.withColumns({"own": F.when(F.col("n").isNotNull(), F.col("anchor")), "deal": F.when(F.col("n").isNull(), F.pmod(F.xxhash64("anchor"), F.lit(deals)))}).drop("n")
    repeats = dealt.groupBy("own", "deal").applyInArrow(lambda t: refine(t.drop(["own", "deal"])), found)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, before, named = [], [], []
            for i, (lead, context) in enumerate(zip(batch.column("lead").to_pylist(), batch.column("context").to_pylist())):
                words = context.split(b" ")
                for start in range(lead - (length - gram), min(lead, len(words) - length) + 1):
                    if start >= 0:
                        rows.append(i)
                        before.append(lead - start)
                        named.append(xxhash.xxh3_128_digest(b" ".join(words[start : start + length])))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (*key, "low", "high")), pa.array(before, pa.int32()), pa.array(named, pa.binary())], names=[*key, "low", "high", "before", "passage"])

    if crowded.limit(1).count():
        many = contexts.join(crowded, "anchor").select(*key, "context", "low", "high").mapInArrow(passages, f"anchor long, lead int, name binary, low {id_type}, high {id_type}, before int, passage binary")
        least = checkpointed(many.groupBy("anchor", "before", "passage").agg(F.min("low").alias("least")))
        joined = many.join(least, ["anchor", "before", "passage"]).where("least < high")
        span = F.struct(F.col("least").alias("low"), (-F.col("before")).alias("begin"), (F.lit(length) - F.col("before")).cast("int").alias("finish"))
        repeats = repeats.unionByName(joined.groupBy(*key).agg(F.collect_set(span).alias("repeats")))
    repeats = checkpointed(repeats)
    hits = met.select("doc_id", "h", *key, "places").join(repeats, key).select("doc_id", "h", "places", F.expr("filter(repeats, r -> r.low < doc_id)").alias("repeats")).where(F.size("repeats") > 0)
    placed = F.flatten(F.transform("places", lambda p: F.transform("repeats", lambda r: F.struct((p + r["begin"]).alias("start"), (p + r["finish"]).alias("end")))))
    spans = checkpointed(hits.select("doc_id", "h", placed.alias("spans")).groupBy("doc_id", "h").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    release(met, met_path)
    release(contexts, contexts_path)
    return Repeats(keyed, profile, copies, spans)


def covered(n: int, spans: list[dict]) -> list[bool]:
    """For each of ``n`` words whether a span covers it."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, [s["start"] for s in spans], 1)
    np.add.at(edges, [s["end"] for s in spans], -1)
    return (np.cumsum(edges[:-1]) > 0).tolist()


def digest_repeats(found: Repeats) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space).

    Rows without a repeat take their digest from the first pass; text is read again only where
    words go.
    """

    @F.pandas_udf("n_removed long, kept string")
    def cut_out(raws: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for raw, gone in zip(raws, spans):
            words = words_of(raw)
            removed = covered(len(words), gone)
            kept = b" ".join([w for w, r in zip(words, removed) if not r])
            out.append((sum(removed), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "kept"])

    changed = found.rows.join(found.spans, ["doc_id", "h"]).select("doc_id", "h", cut_out("raw", "spans").alias("c")).select("doc_id", "h", "c.n_removed", "c.kept").dropDuplicates(["doc_id", "h"])
    gone = found.copies.select("doc_id", "h", F.lit(-1).cast("long").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept"))
    return found.profile.join(changed.unionByName(gone), ["doc_id", "h"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("n_removed") == -1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("kept", F.lower(F.hex("whole"))).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50, gram: int = 16) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a kept word keeps the white space after it.

    Rows, order of columns and all other columns stay; a text whose words all go becomes empty.
    """
    found = find_repeats(docs, text, doc_id, length, gram)
    none = F.lit(None).cast(found.spans.schema["spans"].dataType)
    marks = found.spans.withColumn("all_gone", F.lit(False)).unionByName(found.copies.withColumns({"spans": none, "all_gone": F.lit(True)}))
    mark = fresh_name(docs, "repeat_mark")
    marks = marks.select(F.struct("doc_id", "h", "all_gone", "spans").alias(mark))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, gone in zip(texts, spans):
            if gone is None:
                out.append(value)
                continue
            raw, at, starts = value.encode(), 0, []
            words = words_of(raw)
            for word in words:
                at = raw.index(word, at)
                starts.append(at)
                at += len(word)
            removed = covered(len(words), gone)
            parts = [raw[: starts[0]]] if not removed[0] else []
            parts += [raw[a:b] for a, b, r in zip(starts, [*starts[1:], len(raw)], removed) if not r]
            out.append(b"".join(parts).decode())
        return pd.Series(out, dtype=object)

    same = (docs[doc_id] == F.col(f"{mark}.doc_id")) & (F.xxhash64(docs[text]) == F.col(f"{mark}.h"))
    joined = docs.join(marks, same, "left")
    kept = F.when(F.col(f"{mark}.all_gone"), F.lit("")).otherwise(cut_out(docs[text], F.col(f"{mark}.spans")))
    return joined.select(*[kept.alias(c) if c == text else docs[c] for c in docs.columns])
