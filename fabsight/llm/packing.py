"""Harmonic packing of token sequences.

A document's ids are cut into pieces whose lengths are reciprocals of the capacity (capacity // k), so every class has one
length and its bins take a fixed number of pieces.  Each task numbers its own pieces of a class; the tasks' counts (one row
per task and class) give where a task starts, and bin, slot and offset follow by division.  What is left in the last,
unfinished bin of each class is fewer pieces than a bin holds, for at most 2 * sqrt(capacity) classes: a number that does
not depend on the input (about 21 500 pieces for 4 096).  These are put together by first fit, longest piece first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from fabsight.llm.common import durable, session, text_or_empty, uint32_bytes

CAPACITY = 4096
END_ID = 2
#: Words whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_200_000, 64
#: The characters of plain texts, on which the vocabulary's normalisation is lower case alone, and its words there.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-zß-öø-ÿ0-9]+")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, slot long")


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of ``n`` ids: whole bins, then always the largest reciprocal of the capacity that fits."""
    lengths = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        length = capacity // -(-capacity // rest)
        lengths.append(length)
        rest -= length
    return lengths


class WordIds:
    """Token ids of texts by the tokenizers library, which sees every different word of plain texts once.

    The vocabulary lower-cases, drops white space and ends every word with a token that says so.  Texts with characters beyond
    the plain ones, or with what may be a special string, go to the library as they are.
    """

    _made: dict[str, WordIds] = {}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(names.values()), dtype=bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> WordIds:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: one call for all, cut where a token ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        last = np.flatnonzero(self.ends[ids]) if len(ids) else np.zeros(0, dtype=np.int64)
        if len(last) != len(words) or (len(last) and last[-1] != len(ids) - 1):  # a word of more than one part
            parts = [uint32_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        else:
            raw, stops = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
            parts = [raw[x:y] for x, y in zip(stops, stops[1:])]
        self.words.update(zip(words, parts, strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if len(self.words) > REMEMBERED:
            self.words.clear()
        known = self.words
        found = [PLAIN_WORDS.findall(t.lower()) if "<|" not in t and PLAIN.fullmatch(t) else None for t in texts]
        missing = list({w for words in found if words for w in words if w not in known})
        if missing:
            self._learn(missing)
        out = [self._whole(t) if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, found, strict=True)]
        for w in missing:
            if len(w) > LONGEST:
                del known[w]
        return out

    def _whole(self, text: str) -> bytes:
        return uint32_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)


def tokenized_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    end = uint32_bytes([end_id])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, used = WordIds.of(vocabulary), TaskContext.get().partitionId(), {}
        for batch in batches:
            out = []
            for doc, ids in chain.from_iterable(zip(part.column(0).to_pylist(), words.ids(part.column(1).to_pylist()), strict=True)
                                                for part in (batch.slice(at, 100) for at in range(0, batch.num_rows, 100))):
                ids += end
                start, n = 0, len(ids) // 4
                for length in cuts(n, capacity):
                    slot = used.get(length, 0)
                    used[length] = slot + 1
                    out.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), n, part, slot))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32(), pa.int64()], strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "slot"])

    return docs.mapInArrow(cut, PIECES)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the order given."""
    room = np.zeros(0, dtype=np.int64)
    bins, offsets = [], []
    for length in lengths:
        fits = room >= length
        b = int(fits.argmax()) if fits.any() else len(room)
        if b == len(room):
            room = np.append(room, capacity)
        bins.append(b)
        offsets.append(int(capacity - room[b]))
        room[b] -= length
    return bins, offsets


def harmonic_pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  end_id: int = END_ID) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids; one row per piece.

    A null text is an empty one (its end id alone is packed); null and repeated ids are kept, every row is a document of its
    own; other columns are ignored, whatever their names; no rows give no rows.  ``sequence_id`` and ``offset`` place a piece;
    the ids of a sequence are gapless from offset 0.
    """
    session(docs.sparkSession)
    pieces = durable(tokenized_pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col)), vocabulary,
                                      capacity, end_id))
    # a row per task and class
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("length")
    starts = counts.select("part", "length",
                           (F.sum("n").over(by_class.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
                           F.sum("n").over(by_class).alias("total"))
    per_bin = F.expr(f"{capacity} div length")
    place = F.col("before") + F.col("slot")
    placed = (pieces.join(starts, ["part", "length"])
              .withColumn("bin", F.expr(f"(before + slot) div ({capacity} div length)"))
              .withColumn("whole", F.col("bin") < F.expr(f"total div ({capacity} div length)"))
              .withColumn("offset", (place % per_bin) * F.col("length")))
    wanted = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = placed.where("whole").withColumn("sequence_id", F.shiftleft(F.col("length"), 40) + F.col("bin")).select(*wanted)

    def rest(frames):
        import pandas as pd

        left = pd.concat(list(frames))
        if len(left):
            left = left.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
            bins, left["offset"] = first_fit(left["length"].tolist(), capacity)
            left["sequence_id"] = [(1 << 60) + b for b in bins]
            yield left[wanted]

    # bounded by the capacity alone: fewer pieces than a bin holds in each of at most 2 * sqrt(capacity) classes
    left = placed.where("NOT whole").select(*wanted[:-2]).repartition(1).mapInPandas(
        rest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return full.unionByName(left)


