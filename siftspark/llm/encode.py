"""Encoding of a corpus with a public byte-level BPE vocabulary.

The vocabulary is turned into a sentencepiece BPE model without any training: every
byte string becomes a piece of printable characters (one for each byte), its score is
its negative rank, and the normaliser is the identity. Merging the adjacent pair with the
highest score is then merging the pair with the lowest rank. Texts are cut into pre-tokens
by the vocabulary's pattern first, as merges never cross them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens remembered by a Python worker; beyond that the memory is emptied and filled anew.
REMEMBERED = 200_000
#: Longer pre-tokens are encoded but not remembered.
REMEMBERED_CHARS = 64


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def model_from_ranks(path: str) -> bytes:
    """A serialised sentencepiece BPE model of the ranks in ``path`` (base64 token, blank, rank)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    of_byte = byte_characters()
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(bytes.strip, lines)))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    model = pb.ModelProto()
    for rank, token in ranked:
        piece = model.pieces.add()
        piece.piece, piece.score, piece.type = "".join(of_byte[b] for b in token), -float(rank), pb.ModelProto.SentencePiece.NORMAL
    unknown = model.pieces.add()  # never met: every byte is a piece
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranked)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Encoder:
    """Encodes and decodes single texts by a serialised model."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.to_characters = dict(enumerate(byte_characters()))
        self.to_byte = {ord(c): b for b, c in self.to_characters.items()}
        self.known: dict[str, array] = {}

    def _new(self, token: str) -> array:
        ids = array("i", self.processor.encode(token.encode("utf-8", "replace").decode("latin-1").translate(self.to_characters)))
        if len(token) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        if text:
            known = self.known
            for token in self.cut(text):
                out.extend(known.get(token) or self._new(token))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        return sum(len(known.get(token) or self._new(token)) for token in self.cut(text))

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(self.processor.id_to_piece(int(i)) for i in ids)
        return bytes(self.to_byte[ord(c)] for c in text).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(model: bytes, pattern: str) -> Encoder:
    return Encoder(model, pattern)


class Vocabulary:
    """A model made once on the driver (about 1 MB, fixed by the vocabulary) and sent to each executor once."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str | None = None) -> None:
        self._model = spark.sparkContext.broadcast(model_from_ranks(path or default_vocabulary()))
        self._pattern = pattern or default_pattern()

    def ids(self, text: Column) -> Column:
        """Token ids of each text; null and empty texts give the empty list."""
        model, pattern = self._model, self._pattern

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            encoder = _encoder(model.value, pattern)
            flat, ends = array("i"), array("i", [0])
            for value in texts:
                flat.extend(encoder.encode(value.as_py()))
                ends.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))

        return run(text)

    def count(self, text: Column) -> Column:
        """Number of tokens of each text, 0 for null and empty ones."""
        model, pattern = self._model, self._pattern

        @F.arrow_udf("int")
        def run(texts: pa.Array) -> pa.Array:
            encoder = _encoder(model.value, pattern)
            return pa.array([encoder.count(value.as_py()) for value in texts], pa.int32())

        return run(text)

    def text(self, ids: Column) -> Column:
        """The text of each list of ids; null for null."""
        model, pattern = self._model, self._pattern

        @F.arrow_udf("string")
        def run(lists: pa.Array) -> pa.Array:
            encoder = _encoder(model.value, pattern)
            return pa.array([None if (v := value.as_py()) is None else encoder.decode(v) for value in lists], pa.string())

        return run(ids)


def encode_corpus(documents: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``documents`` with the column ``out``: the token ids of ``text``, without special tokens.

    One pass without a shuffle. Null and empty texts give the empty list; strings that look
    like special tokens are ordinary text; repeated rows and further columns stay as they are;
    ``out`` replaces a column of that name.
    """
    return documents.withColumn(out, Vocabulary(documents.sparkSession, vocabulary, pattern).ids(F.col(text)))
