"""SentencePiece encoding and decoding through the tokenizers library.

The model protobuf is parsed here (public wire format), and its normaliser,
metaspace marker, scores and byte fallback are rebuilt as a ``tokenizers``
pipeline: a BPE model takes its merge order from the piece scores, a unigram
model takes the scores themselves. Batches are encoded by the library's own
threads, and every text's ids can be held against the original library.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows each get their own row; an empty table gives an empty result;
other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import slices, small_batches, text_column
from blockquery.llm.token_count import _NO_PREFIX, _PRETOKEN, CACHE_CHARS, CACHE_ENTRIES, MARK, read_model, splits_at_marks
from blockquery.session import table

BATCH_BYTES = 1 << 20
RUN_WORDS = 2048
THREADS = 2

# Fixed values of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                if wire != 2:
                    raise ValueError(f"wire type {wire} at byte {at}")
                size = varint()
            yield number, data[at : at + size]
            at += size


def parse_model(data: bytes) -> PieceModel:
    """Pieces, scores and the trainer's and normaliser's settings of a model file."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type = trainer.get(3, model.model_type)
            model.byte_fallback = bool(trainer.get(35, model.byte_fallback))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, model.charsmap)
            model.add_dummy_prefix = bool(spec.get(3, model.add_dummy_prefix))
            model.remove_extra_whitespaces = bool(spec.get(4, model.remove_extra_whitespaces))
            model.escape_whitespaces = bool(spec.get(5, model.escape_whitespaces))
    return model


def merge_order(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join into a piece, best score first."""
    usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = [
        (-score, cut, piece[:cut], piece[cut:])
        for piece, score in usable.items()
        for cut in range(1, len(piece))
        if piece[:cut] in usable and piece[cut:] in usable
    ]
    found.sort(key=lambda x: x[:2])
    return [(a, b) for _, _, a, b in found]


def build_tokenizer(data: bytes):
    """The model file as a ``tokenizers.Tokenizer`` with the same ids."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(data)
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), 0)
    if model.model_type == BPE:
        tokenizer = Tokenizer(
            models.BPE(
                vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
                merges=merge_order(model),
                unk_token=model.pieces[unknown][0],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        )
        if splits_at_marks(data):
            tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    elif model.model_type == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback))
    else:
        raise ValueError(f"model type {model.model_type} has no subword segmentation")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_whitespaces else " "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


@dataclass
class Built:
    """What the driver derives from a model once, shipped to every task."""

    data: bytes
    split: bool
    tokenizer: str

    @classmethod
    def of(cls, data: bytes) -> Built:
        split = splits_at_marks(data)
        data = data + _NO_PREFIX if split else data
        return cls(data, split, build_tokenizer(data).to_str())


class Codec:
    """Whole texts to packed little-endian int32 ids and back.

    Where the vocabulary is proven to split at word marks, only the distinct
    words that are not known yet are encoded, ``RUN_WORDS`` of them end to end:
    the backend splits them again at the same places. The library encodes and
    decodes the same runs, for the parity test. Known ids are kept up to a
    bounded number. Texts with unusual spaces or marks go by their pre-tokens,
    and those of other models whole.
    """

    def __init__(self, built: Built, prefix: bool, verify: bool = True):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model, self.split = parse_model(built.data), built.split
        self.tokenizer = Tokenizer.from_str(built.tokenizer)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=built.data) if verify else None
        self.prefix = MARK if prefix else ""
        #: ids of words that follow a mark, and of other units
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.differ: set[str] = set()
        pieces = self.model.pieces
        self.opens = np.array([p.startswith(MARK) for p, _, _ in pieces], bool)
        self.control = np.array([kind == CONTROL for _, _, kind in pieces], bool)
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.first = np.cumsum(self.length) - self.length

    def _agrees(self, units: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library gives the same ids, and both libraries the same text for them."""
        if self.library is None:
            return [True] * len(units)
        own = self.tokenizer.decode_batch(ids)
        return [x == y and t == u for x, y, t, u in zip(ids, self.library.encode(units, num_threads=1), own, self.library.decode(ids), strict=True)]

    def _encode_units(self, units: list[str]) -> dict[str, bytes]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        self.differ.update(u for u, ok in zip(units, self._agrees(units, ids), strict=True) if not ok)
        return {u: struct.pack(f"<{len(x)}i", *x) for u, x in zip(units, ids, strict=True)}

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        parts = [words[a : a + RUN_WORDS] for a in range(0, len(words), RUN_WORDS)]
        runs = [MARK + MARK.join(part) for part in parts]
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        out: dict[str, bytes] = {}
        for part, own, same in zip(parts, ids, self._agrees(runs, ids), strict=True):
            packed = np.array(own, "<i4")
            cuts = np.flatnonzero(self.opens[packed])
            if same and len(cuts) == len(part):
                blob = packed.tobytes()
                at = [*(4 * cuts).tolist(), len(blob)]
                out.update(zip(part, map(blob.__getitem__, map(slice, at[:-1], at[1:])), strict=True))
            else:
                found = self._encode_units([MARK + w for w in part])
                self.differ.update(w for w in part if MARK + w in self.differ)
                out.update((w, found[MARK + w]) for w in part)
        return out

    def _parts(self, text: str) -> tuple[bool, list[str]]:
        """(True, words that follow a mark each) or (False, units) of a text."""
        if not text or not self.split:
            return False, [text] if text else []
        if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return True, text.split(" ")
        return False, _PRETOKEN.findall(self.prefix + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of each text, and whether the library agrees."""
        if len(self.words) + len(self.units) > CACHE_ENTRIES:
            self.words.clear()
            self.units.clear()
            self.differ.clear()
        parts = [self._parts(t) for t in texts]
        long = []
        for plain, known, encode in ((True, self.words, self._encode_words), (False, self.units, self._encode_units)):
            missing = set().union(*(own for p, own in parts if p == plain)).difference(known)
            if missing:
                known |= encode(list(missing))
                long += [(known, u) for u in missing if len(u) > CACHE_CHARS]
        ids = [b"".join(map((self.words if plain else self.units).__getitem__, own)) for plain, own in parts]
        same = [self.differ.isdisjoint(own) for _, own in parts] if self.differ else [True] * len(parts)
        for known, u in long:
            del known[u]
            self.differ.discard(u)
        return ids, same

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids by the backend; bytes that are not UTF-8 become replacement characters."""
        texts = self.tokenizer.decode_batch([[i for i in x if not self.control[i]] for x in ids])
        return [t[1:] if self.split and self.prefix and t[:1] == " " else t for t in texts]

    def spell(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that the ids of each text spell, all texts at once."""
        ids = np.frombuffer(b"".join(packed), "<i4")
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - ends + length, length)
        out = self.spelled[at].tobytes()
        cuts = np.append(0, ends)[np.cumsum([0, *(len(x) // 4 for x in packed)])].tolist()
        drop = 1 if self.prefix else 0
        return [out[a + drop : b] if out[a : a + 1] == b" " else out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_decode(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
    verify: bool = True,
) -> DataFrame:
    """Per row: id, ids (if kept), n_tokens, ids_sha256 (over little-endian int32 ids), decoded_ok, parity.

    ``decoded_ok`` tells that what the ids spell is the text (a text that itself
    holds the mark character has a space there, as in the library); ``parity``
    that the original library gives the same ids, and the same text for them as
    the backend (null when not verified). One pass, no shuffle.
    """
    data = read_model(model_path)
    built, prefix = Built.of(data), parse_model(data).add_dummy_prefix
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_ok boolean, parity boolean"

    def run(batches):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import pyarrow as pa

        codec = Codec(built, prefix, verify)
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, BATCH_BYTES):
                part = texts.slice(a, b - a).to_pylist()
                packed, same = codec.encode(part)
                ids = [np.frombuffer(x, "<i4") for x in packed]
                columns = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in packed]),
                    pa.array([x == t.encode() for x, t in zip(codec.spell(packed), part, strict=True)], pa.bool_()),
                    pa.array(same if verify else [None] * len(part), pa.bool_()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_ok", "parity"]
                if keep_ids:
                    columns.insert(1, pa.array(ids, pa.list_(pa.int32())))
                    names.insert(1, "ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` through encoding, decoding and the parity test."""
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


QUERIES = {"op8_pieces": op8_pieces}
