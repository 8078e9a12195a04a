"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs.

The agenda holds each adjacent pair that is a piece, best score first and leftmost first among equals; what it pops is
merged unless one side has been merged meanwhile. Texts are cut where no piece can reach across, so that a stretch seen
before is looked up. Identifiers come back as little-endian unsigned 32-bit integers in a binary column, and each Arrow
batch is encoded once more by the sentencepiece library, in slices of bytes: column agrees says for each row whether both
give the same.

Defined cases: null and empty texts have the begin and end identifiers only and decode to the empty text; a space and
U+2581 are the same to the vocabulary, so both decode to a space; strings of control pieces inside texts are ordinary text;
characters without a piece become byte pieces; a text of any length takes n log n steps, in the task of its row; repeated
rows are coded alike; a null key stays null; other columns of the input are not read. Vocabularies that aren't of the merge
type, that normalise texts or hold user-defined pieces are refused with a ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_buffers, give_back, once_a_worker, slices

SPACE = "▁"
LONGEST_KEPT, MOST_KEPT, SLICE_BYTES = 48, 800_000, 1 << 20


class _Kept(dict):
    """Stretches seen before; others are made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, s: str) -> bytes:
        return self.make(s)


class PieceCodec:
    """Encodes and decodes by a sentencepiece model file of kind BPE."""

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self._refuse_others(lib.serialized_model_proto())
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        order = {s: k for k, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        self.order = {p: order[lib.get_score(i)] for p, i in self.ids.items()}
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.control = {i for i in range(size) if lib.is_control(i)}
        self.as_byte = {i: b for b, i in enumerate(self.byte_ids) if lib.is_byte(i)}
        self.surface = [b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else bytes([self.as_byte[i]]) if i in self.as_byte else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.leads = {i for p, i in self.ids.items() if p.startswith(SPACE)}
        self.cut = self._cuts(re)
        self.coded = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.kept = _Kept(self._stretch)

    @staticmethod
    def _refuse_others(proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces) or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only merge-type vocabularies with byte pieces that take texts as they are can be used")

    def _cuts(self, re):
        """A pattern of the stretches no piece reaches across: characters are of one kind if pieces have them side by side,
        and spaces only lead. None where spaces don't bound pieces."""
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            return None
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                kind[c] = c = kind[kind[c]]
            return c

        led = set()
        for p in self.ids:
            q = p.lstrip(SPACE)
            led |= {q[0]} if q and len(q) < len(p) else set()
            for c, d in zip(q, q[1:]):
                kind[root(d)] = root(c)
        kinds: dict[str, list[str]] = {}
        for c in kind:
            kinds.setdefault(root(c), []).append(c)
        runs = "|".join(f"[{re.escape(''.join(k))}]+" for k in sorted(kinds.values(), key=len, reverse=True))
        lone = re.escape("".join(led - kind.keys())) or SPACE
        return re.compile(f"{SPACE}*(?:{runs or SPACE}|[{lone}])|{SPACE}+|[^{SPACE}]", re.S).findall

    def merge(self, text: str) -> list[str]:
        """The pieces of one stretch, spaces being U+2581 already. An agenda entry holds rank, left end and length of a pair."""
        n, order = len(text), self.order
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << 48 | i << 16 | 2 for i in range(n - 1) if (r := order.get(text[i : i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            top = pop(agenda)
            i = top >> 16 & 0xFFFFFFFF
            j = after[i]
            if not j or j >= n or (k := after[j]) - i != top & 0xFFFF:
                continue  # one of the two has been merged meanwhile
            after[i], after[j] = k, 0
            if k < n:
                before[k] = i
                if (r := order.get(text[i : after[k]])) is not None:
                    push(agenda, r << 48 | i << 16 | after[k] - i)
            if (h := before[i]) >= 0 and (r := order.get(text[h:k])) is not None:
                push(agenda, r << 48 | h << 16 | k - h)
        out, i = [], 0
        while i < n:
            out.append(text[i : after[i]])
            i = after[i]
        return out

    def _coded(self, piece: str) -> bytes:
        """A piece's identifier, or those of its bytes."""
        return b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode())

    def _stretch(self, s: str) -> bytes:
        coded = self.coded
        ids = b"".join([coded.get(p) or self._coded(p) for p in self.merge(s)])
        if len(s) <= LONGEST_KEPT:
            if len(self.kept) >= MOST_KEPT:
                self.kept.clear()
            self.kept[s] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Identifiers of a text, with begin and end, as little-endian unsigned 32-bit integers."""
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        if not text:
            return begin + end
        text = SPACE + text.replace(" ", SPACE)
        return begin + b"".join(map(self.kept.__getitem__, self.cut(text) if self.cut else [text])) + end

    def decode(self, ids: bytes) -> str:
        """The text of identifiers; the space before the first piece goes, and bytes that are no UTF-8 become U+FFFD, one each."""
        ids = np.frombuffer(ids, "<u4")
        inner = any((ids[1:-1] == c).any() for c in self.control)  # runs of bytes end there
        ids = ids.tolist()
        lead = next((i for i in ids if i not in self.control), None) in self.leads
        if not inner:
            try:
                return b"".join(map(self.surface.__getitem__, ids))[lead:].decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids)[lead:]

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.as_byte:
                run.append(self.as_byte[i])
                continue
            at = bytes(run)
            while at:
                try:
                    out.append(at.decode())
                    at = b""
                except UnicodeDecodeError as e:
                    out.append(at[: e.start].decode() + "�")
                    at = at[e.start + 1 :]
            run.clear()
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (binary), decoded and agrees of every row; path: a model file that every executor has."""
    import pyarrow as pa

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids binary, decoded string, agrees boolean"

    def run(batches: Iterator) -> Iterator:
        codec = once_a_worker(("pieces", path), lambda: PieceCodec(path))
        for b in batches:
            _, offsets = column_buffers(b.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                part = b.slice(i, j - i)
                texts = part.column(1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                decoded = [codec.decode(x) for x in ids]
                theirs = codec.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
                agrees = [np.array(x, "<u4").tobytes() == y for x, y in zip(theirs, ids)]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["key", "ids", "decoded", "agrees"])
                del texts, ids, decoded, theirs
            give_back()

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode_ids(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded of rows that hold identifiers as encode_decode gives them; null decodes to the empty text."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator) -> Iterator:
        codec = once_a_worker(("pieces", path), lambda: PieceCodec(path))
        for b in batches:
            yield b.assign(decoded=[codec.decode(bytes(x) if x is not None else b"") for x in b["ids"]])[["key", "decoded"]]

    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, decoded string").withColumnRenamed("key", key)


def op12_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and agrees (the library gives the same identifiers)."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees")
