"""Token counts by the whole-token shortcut.

A BPE vocabulary in which no string holds a word mark after another character
can never merge across such a place, so a text splits there into pre-tokens
that encode independently. ``whole_tokens`` proves offline, with the library
itself, which vocabulary strings encode alone as one token. Pre-tokens found in
that table count one each; only the others are merged by the library.

Defined results: null and empty texts count 0 bytes and 0 tokens; repeated rows
each get their own row; an empty table gives an empty result; columns of the
input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import re

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockquery.llm.common import text_column
from blockquery.session import table

MARK = "▁"
TOKEN_LIMIT = 4096
CACHE_ENTRIES = 200_000
CACHE_CHARS = 64
MODEL_BYTES_MAX = 16 << 20
#: normalizer_spec {add_dummy_prefix: false}, merged by protobuf into a model it is appended to
_NO_PREFIX = b"\x1a\x02\x18\x00"
_PRETOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_INNER_MARK = re.compile(f"[^{MARK}]{MARK}")


def read_model(path: str) -> bytes:
    """The model file, read on the driver; its size is checked because it is shipped to every task."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > MODEL_BYTES_MAX:
        raise ValueError(f"{path}: {len(data)} bytes exceed the {MODEL_BYTES_MAX} that may be shipped to tasks")
    return data


def splits_at_marks(model: bytes) -> bool:
    """True if the model's normaliser only replaces spaces and no piece holds a mark after another character."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    probe = " a  b\t ﬁ "
    plain = sp.normalize(probe) in (MARK + probe.replace(" ", MARK), probe.replace(" ", MARK))
    pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
    return plain and not any(_INNER_MARK.search(p) for p in pieces)


def whole_tokens(model: bytes) -> frozenset[str]:
    """Vocabulary strings that are a pre-token and that the library encodes alone as one token."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
    pieces = [
        p
        for i in range(sp.vocab_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        and _PRETOKEN.fullmatch(p := sp.id_to_piece(i))
    ]
    return frozenset(p for p, ids in zip(pieces, sp.encode(pieces), strict=True) if len(ids) == 1)


class _Counts(dict):
    """Tokens of a pre-token; misses are merged by the library and kept up to a bounded number."""

    def __init__(self, model: bytes, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole = whole
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)

    def __missing__(self, pretoken: str) -> int:
        n = len(self.sp.encode(pretoken))
        if len(pretoken) <= CACHE_CHARS:
            if len(self) >= len(self.whole) + CACHE_ENTRIES:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[pretoken] = n
        return n


class TokenCounter:
    """Counts of whole texts, equal to ``len(library.encode(text))``."""

    def __init__(self, model: bytes, whole: frozenset[str] | None = None):
        self.exact_split = splits_at_marks(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = MARK if len(self.library.normalize("a")) == 2 else ""
        self.counts = _Counts(model, whole_tokens(model) if whole is None else whole)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact_split:
            return len(self.library.encode(text))
        found = _PRETOKEN.findall(self.prefix + text.replace(" ", MARK))
        return sum(map(self.counts.__getitem__, found))


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit. One pass, no shuffle."""
    model = read_model(model_path)
    whole = whole_tokens(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = TokenCounter(model, whole)
        for batch in batches:
            texts = text_column(batch, "text")
            n_tokens = [counter.count(t.as_py()) for t in texts]
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, schema)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_token_count": op1_token_count}
