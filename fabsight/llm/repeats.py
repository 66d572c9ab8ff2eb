"""Repeated byte strings by a sparse enhanced suffix array.

Anchors are positions whose 32-byte hash is least in a window, so every string of ``LEAST`` bytes holds an anchor, and equal
strings hold it at the same place.  Only anchors whose 32 bytes occur again are followed up.  For each such group of anchors
the suffixes (the ``LEAST`` bytes from the anchor on) are sorted and a stack scan over their common-prefix lengths gives the
tree of intervals.  Inside an interval the left contexts are sorted too, which tells for every member where its left extension
parts from all others: there the repeat is left-diverse, as the interval makes it right-diverse, so it is maximal.  Every
occurrence is given out, under the name of its longest repeat in that interval.  Contexts reach ``LEAST`` bytes to both sides; a longer repeat comes as overlapping pieces,
one for each anchor in it, which cover the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fabsight.llm.common import durable, session, text_or_empty

LEAST, GRAM = 200, 32
#: Rows that a task gathers before it scans them, and anchors of one group that it can hold; of larger groups the strings
#: themselves are counted.
SCAN_ROWS, GROUP = 20_000, 65_536
PAD = 0xFF  # no UTF-8 text holds it


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from every position on, by doubling."""
    h, base, width = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        base, width = base * base, 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or largest of every ``size`` values in a row."""
    width = 1
    while 2 * width <= size:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes: every string of ``least`` bytes holds the whole gram of one."""
    window = least - GRAM + 1
    if len(b) < least:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = gram_hashes(b)
    low = _sliding(h, window, np.minimum)
    edge = np.zeros(window - 1, dtype=np.uint64)
    highest_low = _sliding(np.concatenate([edge, low, edge]), window, np.maximum)
    at = np.flatnonzero(h == highest_low)
    return at, h[at]


def contexts(b: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes before each anchor, nearest first, and from it on."""
    edge = np.full(least, PAD, dtype=np.uint8)
    wide = np.concatenate([edge, b, edge])
    step = np.arange(least)
    return wide[at[:, None] + (least - 1 - step)], wide[at[:, None] + (least + step)]


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row with the next."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix interval tree of a sorted run: (first, end, length) of every interval of at least ``least``."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, n in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield first, i + 1, length
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, first))


def scan(group: np.ndarray, left: np.ndarray, right: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, l, r): row ``member`` repeats with the l bytes before and the r bytes from its anchor on, at least ``least``.

    Rows are sorted by (group, right); ``room``: bytes before and from the anchor on that the text has.  Deeper intervals come
    first; in a shallower one a member counts only if its left context reaches further there (else the whole interval around
    it goes on alike, and its repeat is part of one that was found).
    """
    lcp = np.minimum(_common(right), np.minimum(room[1:, 1], room[:-1, 1]))  # padding is not text
    lcp[group[1:] != group[:-1]] = 0
    beside = np.minimum(_common(left), np.minimum(room[1:, 0], room[:-1, 0])).tolist()
    reached = np.full(len(group), -1)
    out: list[tuple[np.ndarray | list[int], np.ndarray | list[int], int]] = []
    for first, end, r in intervals(lcp.tolist(), GRAM):
        if end - first == 2:
            if beside[first] + r >= least:
                reached[first:end] = beside[first]
                out.append(([first, first + 1], [beside[first]] * 2, r))
            continue
        order = first + np.argsort(np.ascontiguousarray(left[first:end]).view(f"S{left.shape[1]}").ravel(), kind="stable")
        side = np.minimum(_common(left[order]), np.minimum(room[order[1:], 0], room[order[:-1], 0]))
        # where the left extensions part: the furthest that a member shares with another one
        l = np.maximum(np.append(side, -1), np.insert(side, 0, -1))
        more = (l + r >= least) & (l > reached[order])
        if more.any():
            reached[order[more]] = l[more]
            out.append((order[more], l[more], r))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    return (np.concatenate([m for m, _, _ in out]).astype(np.int64), np.concatenate([l for _, l, _ in out]).astype(np.int64),
            np.repeat([r for _, _, r in out], [len(m) for m, _, _ in out]))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, text, k1, k2) and the columns ``more``: two keys stand for the text."""
    text = F.col("text").cast("binary")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *more)
            .withColumns({"k1": F.xxhash64("text"), "k2": F.crc32(text) + F.shiftleft(F.octet_length("text").cast("long"), 32)}))


def _squeezed(df: DataFrame, name: str = "text") -> DataFrame:
    """``df`` with the texts of a column compressed, for a shuffle."""
    from pyspark.sql import types as T

    names = df.columns
    place = names.index(name)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = pa.array([None if t is None else pack(t.encode()) for t in b.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(b.columns)], names=names)

    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == name else f for f in df.schema.fields])
    return df.mapInArrow(squeeze, schema)


def _unsqueeze():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), dtype=np.uint8)


def _anchor_table(texts: DataFrame, least: int) -> DataFrame:
    """(h, k1, again): the different grams at the anchors of each text, and whether the text has them twice."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                h, k, again = [], [], []
                for text, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    values, counts = np.unique(anchors(_bytes(text), least)[1], return_counts=True)
                    h.append(values.view(np.int64))
                    again.append(counts > 1)
                    k.append(np.full(len(values), key))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.concatenate(k).astype(np.int64)), pa.array(np.concatenate(again).astype(bool))],
                                                 names=["h", "k1", "again"])

    return texts.where(F.octet_length("text") >= least).select("text", "k1").mapInArrow(find, "h long, k1 long, again boolean")


def _context_rows(wanted: DataFrame, least: int) -> DataFrame:
    """(h, k1, k2, at, left, right, before, behind) for every wanted anchor of (text, k1, k2, hs); equal contexts of one text,
    as in a run of one character, come as one row, and as spans (left null, at and behind the ends) for each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unsqueeze()
        for b in batches:
            for s in range(0, b.num_rows, 50):
                part, out = b.slice(s, 50), [[] for _ in range(8)]
                for text, k1, k2, hs in zip(*(c.to_pylist() for c in part.columns)):
                    raw = np.frombuffer(unpack(text), dtype=np.uint8)
                    at, h = anchors(raw, least)
                    at = at[np.isin(h.view(np.int64), np.array(hs, dtype=np.int64))]
                    for block in np.split(at, range(2000, len(at), 2000)):
                        left, right = contexts(raw, block, least)
                        before, behind = np.minimum(block, least), np.minimum(len(raw) - block, least)
                        hashes = gram_at(raw, block)
                        seen: dict[tuple[bytes, bytes], list[int]] = {}
                        for i in range(len(block)):
                            seen.setdefault((left[i].tobytes(), right[i].tobytes()), []).append(i)
                        rows = []
                        for (before_it, from_it), same in seen.items():
                            i = same[0]
                            rows.append((int(hashes[i]), k1, k2, int(block[i]), before_it, from_it, int(before[i]), int(behind[i])))
                            if len(same) > 1 and before[i] + behind[i] >= least:
                                rows += [(k1, k1, k2, int(block[i] - before[i]), None, None, 0, int(block[i] + behind[i])) for i in same]
                        for c, values in zip(out, zip(*rows)):
                            c += values
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                                 names=["h", "k1", "k2", "at", "left", "right", "before", "behind"])

    return wanted.select("text", "k1", "k2", "hs").mapInArrow(
        cut, "h long, k1 long, k2 long, at long, left binary, right binary, before int, behind long")


def gram_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return gram_hashes(raw)[at].view(np.int64) if len(at) else np.zeros(0, dtype=np.int64)


def _repeats_of(rows: DataFrame, least: int) -> DataFrame:
    """(repeat, length, k1, k2, start, end) from context rows, group by group in sorted order."""

    def repeats(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts)
        h, k1, k2, at = (t.column(i).to_numpy() for i in range(4))
        left, right = (np.frombuffer(b"".join(t.column(i).to_pylist()), dtype=np.uint8).reshape(len(h), -1) for i in (4, 5))
        room = np.stack([t.column(6).to_numpy().astype(np.int64), t.column(7).to_numpy()], axis=1)
        member, l, r = scan(h, left, right, room, least)
        if not len(member):
            return None
        names = [int.from_bytes(hashlib.blake2b(left[m, :x][::-1].tobytes() + right[m, :y].tobytes(), digest_size=8).digest(), "little", signed=True)
                 for m, x, y in zip(member.tolist(), l.tolist(), r.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *map(pa.array, (l + r, k1[member], k2[member], at[member] - l, at[member] + r))],
                                          names=["repeat", "length", "k1", "k2", "start", "end"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            spans = b.filter(b.column(4).is_null())
            if spans.num_rows:
                none = pa.nulls(spans.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, spans.column(1), spans.column(2), spans.column(3), spans.column(7)],
                                                 names=["repeat", "length", "k1", "k2", "start", "end"])
            b = b.filter(b.column(4).is_valid())
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            # all groups but the last are complete
            last = int(np.searchsorted(h, h[-1]))
            if n and (last or held[-1].column(0)[-1].as_py() != h[0]):
                if last:
                    held.append(b.slice(0, last))
                    b = b.slice(last)
                if n + last >= SCAN_ROWS:
                    if (out := repeats(held)) is not None:
                        yield out
                    held, n = [], 0
                else:
                    n += last
            held.append(b)
            n += b.num_rows
        if held and (out := repeats(held)) is not None:
            yield out

    return (rows.repartition("h").sortWithinPartitions("h", "right", "k1", "k2", "at")
            .mapInArrow(work, "repeat long, length long, k1 long, k2 long, start long, end long"))


def _counted_strings(wanted: DataFrame, least: int) -> DataFrame:
    """Spans of strings that occur again, for the anchors of groups too large to sort in a task: every string of ``least``
    bytes with such an anchor is counted by 128 bits of its hash, combined before the shuffle."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unsqueeze()
        for b in batches:
            for text, k1, k2, hs in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack(text)
                at, h = anchors(np.frombuffer(raw, dtype=np.uint8), least)
                at = at[np.isin(h.view(np.int64), np.array(hs, dtype=np.int64))]
                near = (at[:, None] - np.arange(least - GRAM + 1)).ravel()
                starts = np.unique(near[(near >= 0) & (near + least <= len(raw))])
                digests = [hashlib.blake2b(raw[s:s + least], digest_size=16).digest() for s in starts.tolist()]
                w = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(len(w), k1)), pa.array(np.full(len(w), k2)), pa.array(starts)],
                                                 names=["w1", "w2", "k1", "k2", "start"])

    rows = wanted.select("text", "k1", "k2", "hs").mapInArrow(strings, "w1 long, w2 long, k1 long, k2 long, start long")
    again = rows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(again, ["w1", "w2"]).select(F.col("w1").alias("repeat"), F.lit(least).cast("long").alias("length"), "k1", "k2", "start",
                                                  (F.col("start") + least).alias("end"))


def maximal_repeats(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(repeat, length, k1, k2, start, end): groups of equal strings of at least ``least`` bytes with their occurrences, but for
    those that are part of a longer one at the same anchor.

    ``texts``: (doc_id, text, k1, k2) as from ``keyed``.  Copies of a text take part once; that they repeat as a whole is the
    caller's to know.  ``repeat`` names a group; it is null for strings that repeat inside one text only, and these have one
    row for each piece.
    """
    found = durable(_anchor_table(texts, least))
    counts = found.groupBy("h").agg(F.min("k1").alias("low"), F.max("k1").alias("high"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n"))
    repeated = durable(counts.where("low <> high OR again").select("h", (F.col("n") > GROUP).alias("hot")))
    anchors_of = found.select("h", "k1").join(repeated, "h")
    reps = texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))

    def wanted(hot: bool) -> DataFrame:
        hs = anchors_of.where(F.col("hot") == hot).groupBy("k1").agg(F.collect_set("h").alias("hs"))
        one = reps.join(hs, "k1").select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), "rep", "hs")
        return _squeezed(texts.select("doc_id", "text", "k1", "k2")).join(one, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("rep")))

    out = _repeats_of(_context_rows(wanted(False), least), least)
    if repeated.where("hot").limit(1).count():
        out = out.union(_counted_strings(wanted(True), least))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, without overlap; neighbours that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _spans(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Per text that has any: its spans; and (k1, k2) of texts that occur more than once and are long enough."""
    per_text = maximal_repeats(texts, least).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    copied = texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").where(F.shiftright("k2", 32) >= least).select("k1", "k2")
    return per_text.withColumnsRenamed({"k1": "s1", "k2": "s2"}), copied.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"))


def _with_spans(rows: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """``rows`` (k1, k2 and others) with ``spans`` (null: none) of bytes to remove; a text with copies is one whole span."""
    spans, copied = _spans(texts, least)
    marked = rows.join(copied, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.shiftright("k2", 32).alias("end")))
    return (marked.join(spans, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
            .withColumn("spans", F.when(F.col("c1").isNotNull(), whole).otherwise(F.col("spans"))).drop("c1", "c2", "s1", "s2"))


def repeat_digests(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, when every byte in a string of ``least`` bytes that also
    starts elsewhere is removed.

    Null texts are empty; texts shorter than ``least`` keep all; copies lose all if long enough; overlaps of a string with
    itself count; ids may be null or repeated, rows are documents; other columns are ignored; no rows give no rows.
    """
    session(docs.sparkSession)
    texts = keyed(docs, id_col, text_col)
    rows = _with_spans(_squeezed(texts), texts, least)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unsqueeze()
        for b in batches:
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack(text)
                runs = merged([(s["start"], s["end"]) for s in spans or ()])
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((doc, len(raw), sum(e - s for s, e in runs), len(runs), kept.hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage of ``least`` bytes or more that also starts elsewhere cut out of the text, all columns kept.

    As ``repeat_digests``, on whole characters: a cut that begins or ends inside a character leaves that character.  Every row
    comes back; a null text stays null.
    """
    session(docs.sparkSession)
    names = docs.columns
    others = [c for c in names if c != text_col]
    row = F.struct(F.lit(1).alias("one"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    texts = keyed(docs.select(row, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{text_col}`").alias("old")),
                  "doc_id", "text", "row", "old")
    rows = _with_spans(_squeezed(texts.select("row", "old", "k1", "k2"), "old"), texts, least)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unsqueeze()
        for b in batches:
            row = b.column(0)
            new = pa.array([None if z is None else without(unpack(z), s or ()) for z, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else row.field(1 + others.index(c)) for c in names], names=names)

    return rows.select("row", "old", "spans").mapInArrow(cut, docs.schema)


def without(raw: bytes, spans: list[dict]) -> str:
    """The text of the bytes without the spans, each drawn in to whole characters."""
    at, out = 0, []
    starts = lambda i: i >= len(raw) or raw[i] & 0xC0 != 0x80
    for s, e in merged([(x["start"], x["end"]) for x in spans]):
        while not starts(s):
            s += 1
        while not starts(e):
            e -= 1
        if s < e:
            out.append(raw[at:s])
            at = e
    return b"".join([*out, raw[at:]]).decode()
