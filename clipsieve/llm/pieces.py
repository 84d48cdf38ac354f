"""SentencePiece encoding and decoding that keeps byte offsets into the original text.

Normalisation is our own: the model's compiled character map is read as a double
array trie, the longest key that matches at each place is replaced, and for every
normalised byte the original byte span is recorded. Places whose byte begins no
key are passed over in numpy, so a model with an empty map takes the same way. The
library then finds the ids; each id's length in normalised bytes projects it to
its span in the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches

#: The mark that stands for a space in pieces: U+2581, three bytes.
MARK = "▁".encode()
#: Original bytes of one call to the library's encoder; longer texts go alone.
BATCH_BYTES = 1_000_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, then the replacements.

    Layout (public format): uint32 size of the trie in bytes, its uint32 units,
    then zero-terminated replacement strings to which the values point.
    """

    def __init__(self, blob: bytes):
        if not blob:
            self.units, self.texts, self.starts = None, b"", np.zeros(256, bool)
            return
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        self.starts = np.array([self._step(0, b) is not None for b in range(256)])

    def _offset(self, node: int) -> int:
        unit = self.units[node]
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def _step(self, node: int, byte: int) -> int | None:
        child = node ^ self._offset(node) ^ byte
        return child if child < len(self.units) and self.units[child] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at ``at`` and its replacement, if any key matches."""
        node, best, i = 0, None, at
        while i < len(data) and (node := self._step(node, data[i])) is not None:
            i += 1
            if self.units[node] >> 8 & 1:
                value = self.units[node ^ self._offset(node)] & 0x7FFFFFFF
                best = (i - at, value)
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1] : end]


class OffsetTokenizer:
    """A SentencePiece model with offset-preserving normalisation."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = pb.ModelProto()
        spec.ParseFromString(model)
        n = spec.normalizer_spec
        self.map = CharacterMap(n.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = spec.trainer_spec.treat_whitespace_as_suffix
        self.user = sorted((p.piece.encode() for p in spec.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED), key=len, reverse=True)
        self.starts = self.map.starts.copy()
        self.starts[[u[0] for u in self.user]] = True
        kind = pb.ModelProto.SentencePiece
        self.width = np.array([{kind.CONTROL: 0, kind.BYTE: 1, kind.UNKNOWN: -1}.get(p.type, len(p.piece.encode())) for p in spec.pieces], np.int64)

    def _replaced(self, data: bytes, source: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Place, width and replacement wherever a user-defined piece or else a key of the map matches, the longest first."""
        at = 0
        for k in np.flatnonzero(self.starts[source]).tolist():
            if k < at:
                continue
            own = next((u for u in self.user if data.startswith(u, k)), None)
            hit = (len(own), own) if own else self.map.longest(data, k) if self.map.starts[data[k]] else None
            if hit:
                at = k + hit[0]
                yield k, *hit

    def normalise(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the begin and end of its source in the original bytes.

        A step is a matched key, or else one character. Squeezing drops a step's
        leading spaces where the text so far ends with a space (or is empty); a
        space becomes its mark, and marks at the end of the text are dropped too.
        """
        data = text.encode()
        source = np.frombuffer(data, np.uint8)
        first = (source & 0xC0) != 0x80
        length = np.ones(len(source), np.int64)
        found = list(self._replaced(data, source))
        for k, width, new in found:
            first[k + 1 : k + width] = False
            length[k : k + width] = 0
            length[k] = len(new)
        out, step = np.repeat(source, length), np.repeat(np.cumsum(first) - 1, length)
        if found:
            to = np.cumsum(length)
            for k, _, new in found:
                out[to[k] - len(new) : to[k]] = np.frombuffer(new, np.uint8)
        if self.squeeze and len(out):
            kept = self._squeezed(out == 0x20, step)
            out, step = out[kept], step[kept]
        begins = np.flatnonzero(first)
        begin, end = begins[step], np.append(begins[1:], len(source))[step]
        if not len(source) or self.squeeze and not len(out):
            return b"", begin, end
        if self.escape:
            width = np.where(out == 0x20, len(MARK), 1)
            begin, end = np.repeat(begin, width), np.repeat(end, width)
        space = MARK if self.escape else b" "
        normal = out.tobytes().replace(b" ", space)
        if self.dummy and not self.suffix:
            here = np.full(len(space), int(begin[0]) if len(begin) else 0)
            normal, begin, end = space + normal, np.concatenate([here, begin]), np.concatenate([here, end])
        if self.squeeze:
            stay = len(normal)
            while normal.endswith(space, 0, stay):
                stay -= len(space)
            normal, begin, end = normal[:stay], begin[:stay], end[:stay]
        if self.dummy and self.suffix:
            here = np.full(len(space), len(source))
            normal, begin, end = normal + space, np.concatenate([begin, here]), np.concatenate([end, here])
        return normal, begin, end

    @staticmethod
    def _squeezed(space: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Which bytes stay: ``space`` marks the spaces, ``step`` numbers the steps that gave them."""
        starts = np.flatnonzero(np.diff(step, prepend=-1))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(step))))
        solid = np.cumsum(~space)
        leading = solid == (solid[starts] - ~space[starts])[run]
        after_space = np.concatenate([[True], space[np.append(starts[1:], len(step)) - 1][:-1]])[run]
        return ~(leading & after_space)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of every id; control ids have empty ones at either side."""
        normal, begin, end = self.normalise(text)
        width = self.width[ids]
        if (unknown := np.flatnonzero(width < 0)).size:
            width = self._unknown(normal, ids, width, unknown)
        to = np.cumsum(width)
        if len(to) and to[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        if not len(normal):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        first = to - width
        a = np.append(begin, end[-1])[first]
        return a, np.where(width == 0, a, end[np.maximum(to - 1, 0)])

    def _unknown(self, normal: bytes, ids: np.ndarray, width: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        """An unknown piece reaches to where the next known one begins."""
        width, at = width.copy(), 0
        for k in range(len(ids)):
            if width[k] >= 0:
                at += width[k]
                continue
            follow = next((self.lib.id_to_piece(int(i)).encode() for i in ids[k + 1 :] if self.width[i] > 1), None)
            to = normal.find(follow, at + 1) if follow else len(normal)
            width[k] = (to if to >= 0 else len(normal)) - at
            at += width[k]
        return width

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The library's ids of each text, begin and end of text included."""
        return [np.array(ids, "<u4") for ids in self.lib.encode(list(texts), add_bos=True, add_eos=True, num_threads=1)]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def _tokenizer(model: bytes) -> OffsetTokenizer:
    return OffsetTokenizer(model)


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_OUTPUTS = {
    "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "begins": T.ArrayType(T.LongType()), "ends": T.ArrayType(T.LongType()),
    "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "covered": T.LongType(),
}


def encode(docs: DataFrame, model: bytes, outputs: Sequence[str] = ("n_tokens", "ids", "begins", "ends", "decoded"),
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the chosen outputs for every row of ``docs``.

    ``ids`` include begin and end of text; ``begins`` and ``ends`` are byte
    offsets into the original text (UTF-8), ``decoded`` is the model's decoding
    of the ids, ``covered`` the number of original bytes within spans; the
    ``_sha256`` columns are hex digests of the ids as little-endian unsigned
    32-bit integers and of the decoded text in UTF-8. Null text counts as empty
    and gives the two control ids only. Rows that repeat give repeated rows, an
    empty table none; columns besides the two named are not read. ``model`` is
    the model file's bytes (half a MB), so executors need no access to the file.
    Works row by row in batches of bounded bytes, without any shuffle.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(o, _OUTPUTS[o]) for o in outputs)])
    wanted = tuple(outputs)

    bound_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BATCH_BYTES):
                    size += len(texts[hi])
                    hi += 1
                yield _outputs(tok, batch.column(0).slice(lo, hi - lo), texts[lo:hi], wanted, schema)
                lo = hi

    return docs.select(id_col, text_col).mapInArrow(rows, schema)


def _outputs(tok: OffsetTokenizer, doc_ids: pa.Array, texts: list[str], wanted: tuple[str, ...], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    found: dict[str, list] = {o: [] for o in wanted}
    for text, ids in zip(texts, tok.encode(texts), strict=True):
        packed, ids = ids, ids.tolist()
        begins, ends = tok.spans(text, packed)
        decoded = tok.decode(ids) if "decoded" in wanted or "decoded_sha256" in wanted else None
        for o in wanted:
            found[o].append(
                len(ids) if o == "n_tokens" else ids if o == "ids" else begins if o == "begins" else ends if o == "ends"
                else decoded if o == "decoded" else _digest(packed.tobytes()) if o == "ids_sha256"
                else _digest(decoded.encode()) if o == "decoded_sha256" else _covered(begins, ends))
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([doc_ids.cast(arrow.field(0).type), *(pa.array(found[o], arrow.field(i + 1).type) for i, o in enumerate(wanted))], schema=arrow)


def _covered(begins: np.ndarray, ends: np.ndarray) -> int:
    """Bytes within at least one span; spans come in order."""
    if not len(ends):
        return 0
    until = np.maximum.accumulate(np.concatenate([[0], ends[:-1]]))
    return int(np.maximum(ends - np.maximum(begins, until), 0).sum())


def decode(rows: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` for rows with an array of ids; null ids give an empty text."""
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = _tokenizer(model)
        for frame in frames:
            yield pd.DataFrame({id_col: frame[id_col], "decoded": [tok.decode([int(i) for i in x]) if x is not None else "" for x in frame[ids_col]]})

    return rows.select(id_col, ids_col).mapInPandas(texts, schema)
