"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A piece's count is its bytes (the initial symbols) less the merges done: the adjacent pair of lowest rank,
leftmost first, is popped until none is left. Defined cases: null and empty texts have 0 tokens; a piece of
any length takes n log n steps; repeated rows are counted alike; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once_a_worker

#: Fixed value: the pre-tokenization pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_KEPT, MOST_KEPT = 48, 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1 character for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of texts by a tokenizers JSON file of kind BPE with byte-level pre-tokenization."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        code = {bytes([i]): i for i in range(256)}  # equal bytes, equal code, whichever merge they came from
        self.ranks: dict[int, int] = {}
        self.pair, self.made = [], []
        for m in spec["model"]["merges"]:
            a, b = map(raw, m if isinstance(m, list) else m.split(" "))
            pair = code.setdefault(a, len(code)) << 24 | code.setdefault(b, len(code))
            self.ranks.setdefault(pair, len(self.pair))
            self.pair.append(pair)
            self.made.append(code.setdefault(a + b, len(code)))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.pieces = regex.compile(PATTERN).findall
        self.younger = self._younger()
        self.kept: dict[str, int] = {}

    @staticmethod
    def _younger():
        """Finds characters that the pattern engine knows and the vocabulary's library doesn't yet: those without a category here."""
        import regex

        return regex.compile(r"[[\p{L}\p{N}]--[\p{ASCII}]]").findall

    def merge(self, data: bytes) -> int:
        """Tokens of one piece."""
        n = len(data)
        if n < 2:
            return n
        ranks, pair, made = self.ranks, self.pair, self.made
        symbol, after, before = list(data), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := ranks.get(symbol[i] << 24 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if j >= n or symbol[i] << 24 | symbol[j] != pair[r]:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = made[r], -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := ranks.get(symbol[i] << 24 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := ranks.get(symbol[h] << 24 | symbol[i])) is not None:
                heapq.heappush(heap, r << 40 | h)
        return n - merges

    def _piece(self, piece: str) -> int:
        n = self.merge(piece.encode())
        if len(piece) <= LONGEST_KEPT:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            self.kept[piece] = n
        return n

    def _plain(self, text: str) -> int:
        kept, total = self.kept, 0
        if not text.isascii() and (odd := _unassigned(self.younger(text))):
            return sum(self._piece(p) for p in self._pieces_without(text, odd))
        for p in self.pieces(text):
            n = kept.get(p)
            total += self._piece(p) if n is None else n
        return total

    def _pieces_without(self, text: str, odd: set[int]) -> list[str]:
        """The pieces, characters of odd standing as neither letters nor numbers: each is dealt as a private-use character."""
        stand, back = {}, {}
        free = (c for c in range(0xF0000, 0xFFFFE) if chr(c) not in text)
        for c in sorted(odd):
            stand[c] = next(free)
            back[stand[c]] = c
        return [p.translate(back) for p in self.pieces(text.translate(stand))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)


def _unassigned(chars: list[str]) -> set[int]:
    import unicodedata

    return {ord(c) for c in set(chars) if unicodedata.category(c) == "Cn"}


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens and over_limit of every row; path: a vocabulary file that every executor has."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        counter = once_a_worker(("merges", path), lambda: MergeCounter(path))
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_bytes": b["n_bytes"], "n_tokens": [counter.count(t if isinstance(t, str) else None) for t in b["text"]]})

    out = rows.mapInPandas(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary)
