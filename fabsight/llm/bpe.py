"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for a word.  A sequence of tokens is the word's encoding exactly if no merge would ever
cross the border of two neighbours: taking the right spine of the left token and the left spine of the right one, a merge
(x, y) crosses if it comes before both x and y are themselves merged into their parents (on equal rank the leftmost goes
first).  All neighbours of a batch are tested at once; only words that fail are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fabsight.llm.common import session, text_or_empty, uint32_bytes

#: The pattern that splits a text into words, and the white space it means.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0  -     　"
#: A worker remembers so many pieces and words of at most so many characters.
PIECES, WORD_COUNT, LONGEST = 400_000, 1_200_000, 64
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class SpeculativeBpe:
    _made: dict[str, SpeculativeBpe] = {}

    @classmethod
    def of(cls, path: str) -> SpeculativeBpe:
        if path not in cls._made:
            with open(path, encoding="utf-8") as f:
                cls._made[path] = cls(json.load(f))
        return cls._made[path]

    def __init__(self, description: dict):
        import regex

        model = description["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in description["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids_of = {raw(s): i for s, i in model["vocab"].items()}
        self.size = 1 + max([*self.ids_of.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * self.size
        for s, i in self.ids_of.items():
            self.token_bytes[i] = s
        for s, i in self.special.items():
            self.token_bytes[i] = s.encode()
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        left, right = (np.array([model["vocab"][p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        made = np.array([model["vocab"][a + b] for a, b in pairs], dtype=np.int64)
        key = left * self.size + right
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], order
        self.rank_of = dict(zip(zip(left.tolist(), right.tolist()), range(len(pairs))))
        self.merged = made.tolist()
        self._spines(left, right, made)
        self._reachable(left, right, made)
        self.byte_ids = [self.ids_of.get(bytes([b]), -1) for b in range(256)]
        self.words = regex.compile(WORDS.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}"))
        self.pieces = re.compile(f" (?=[^{SPACE}])")
        self.known: dict[str, bytes] = {}
        self.known_words: dict[str, bytes] = {}

    def _spines(self, left, right, made) -> None:
        """For every token its right and left spine, with the rank at which each spine member is merged away."""
        part = {"r": np.full(self.size, -1), "l": np.full(self.size, -1)}
        rank = np.full(self.size, -1)
        for i in range(len(made) - 1, -1, -1):  # the first merge that makes a token stands
            part["r"][made[i]], part["l"][made[i]], rank[made[i]] = right[i], left[i], i
        self.rank, spines = rank, []
        for side in ("r", "l"):
            now, until = np.arange(self.size), np.full(self.size, NEVER)
            members, ends = [], []
            while (now >= 0).any():
                members.append(now)
                ends.append(until)
                has = now >= 0
                until = np.where(has, rank[np.maximum(now, 0)], -1)
                now = np.where(has, part[side][np.maximum(now, 0)], -1)
            spines.append((np.stack(members, 1), np.stack(ends, 1)))
        (self.right_spine, self.right_until), (self.left_spine, self.left_until) = spines

    def compatible(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether no merge crosses the border of the tokens a[i], b[i]; ``whole``: the pair itself counts as a merge too."""
        ok = np.ones(len(a), dtype=bool)
        for i in range(self.right_spine.shape[1]):
            for j in range(self.left_spine.shape[1]):
                if not whole and i == j == 0:
                    continue
                rows = np.flatnonzero(ok & (self.right_spine[a, i] >= 0) & (self.left_spine[b, j] >= 0))
                if not len(rows):
                    break
                x, y = self.right_spine[a[rows], i], self.left_spine[b[rows], j]
                at = np.minimum(np.searchsorted(self.pair_keys, x * self.size + y), len(self.pair_keys) - 1)
                rank = self.pair_ranks[at]
                crosses = (self.pair_keys[at] == x * self.size + y) & (rank < self.right_until[a[rows], i]) & (rank <= self.left_until[b[rows], j])
                ok[rows[crosses]] = False
        return ok

    def _reachable(self, left, right, made) -> None:
        """Tokens that merging their own bytes gives back; only these are proposed."""
        sound = self.compatible(left, right, whole=False)
        good = np.zeros(self.size, dtype=bool)
        good[[i for s, i in self.ids_of.items() if len(s) == 1]] = True
        for i, (a, b, t) in enumerate(zip(left.tolist(), right.tolist(), made.tolist())):
            if self.rank[t] == i:
                good[t] = good[a] and good[b] and sound[i]
        self.proposed = {s: i for s, i in self.ids_of.items() if good[i]}
        # longest token by its first four bytes
        self.reach: dict[bytes, int] = {}
        for s in self.proposed:
            if len(s) >= 4:
                self.reach[s[:4]] = max(self.reach.get(s[:4], 4), len(s))

    def propose(self, word: bytes) -> list[int]:
        out, at, n, tokens, reach = [], 0, len(word), self.proposed, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at:at + 4], 3))
            while end > at and (t := tokens.get(word[at:end])) is None:
                end -= 1
            if end > at:
                out.append(t)
                at = end
            else:  # bytes without a token are left out, as the library does without an unknown token
                at += 1
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        ids = [t for b in word if (t := self.byte_ids[b]) >= 0]
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        ranks, merged = self.rank_of, self.merged
        at = [ranks.get(p, NEVER) for p in zip(ids, ids[1:])]
        while at and (low := min(at)) != NEVER:
            i = at.index(low)
            ids[i:i + 2] = [merged[low]]
            del at[i]
            if i:
                at[i - 1] = ranks.get((ids[i - 1], ids[i]), NEVER)
            if i < len(at):
                at[i] = ranks.get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.rank_of
        todo = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(todo)
        while todo:
            r, i, x, y = heapq.heappop(todo)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (q := ranks.get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(todo, (q, i, ids[i], ids[after[j]]))
            if (k := before[i]) >= 0 and (q := ranks.get((ids[k], ids[i]))) is not None:
                heapq.heappush(todo, (q, k, ids[k], ids[i]))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word: proposals, one test over all neighbours, merging of those that fail."""
        found = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter((t for w in found for t in w), dtype=np.int64, count=int(counts.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(found)), counts)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
            fails = ~self.compatible(pairs // self.size, pairs % self.size)[where]
            for w in np.unique(owner[inside[fails]]).tolist():
                found[w] = self.merge(words[w])
        return found

    def cut(self, text: str) -> list[str]:
        """The text at every space before a non-space: no word reaches across."""
        first, *rest = self.pieces.split(text)
        return ([first] if first else []) + [" " + p for p in rest]

    def split(self, piece: str) -> list[str]:
        """The words of a piece; the pattern is only needed where letters and one mark do not tell."""
        if piece[:1] == " ":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ".," and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        plan: list[list] = []
        for text in texts:
            parts = self.special_split.split(text) if self.special_split else [text]
            plan.append([self.special[p] if i % 2 else self.cut(p) for i, p in enumerate(parts)])
        for cache, most in ((self.known, PIECES), (self.known_words, WORD_COUNT)):
            if len(cache) > most:
                cache.clear()
        known, ids = self.known, self.known_words
        missing = list({p for parts in plan for pieces in parts if not isinstance(pieces, int) for p in pieces if p not in known})
        words = [self.split(p) for p in missing]
        different = list({w for found in words for w in found if w not in ids})
        ids.update(zip(different, map(uint32_bytes, self.encode_words([w.encode() for w in different]))))
        for p, found in zip(missing, words):
            known[p] = b"".join(map(ids.__getitem__, found))
        out = [b"".join(uint32_bytes([x]) if isinstance(x, int) else b"".join(map(known.__getitem__, x)) for x in parts) for parts in plan]
        for cache, added in ((known, missing), (ids, different)):
            for p in added:
                if len(p) > LONGEST:
                    del cache[p]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as little-endian unsigned 32-bit integers, and the text decoded from them.

    Whole texts; a null text is an empty one and has no ids; null and repeated ids are kept row by row; other columns are
    ignored; no rows give no rows.  Special strings of the vocabulary in a text become their ids, as in the library.
    """
    session(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SpeculativeBpe.of(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col)).mapInArrow(encode, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded documents."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


