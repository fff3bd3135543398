"""Token counts: lengths of batch encodings under a public tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import map_arrow, release, slices

#: bytes of text given to the encoder at a time, and of a piece of a long text
BATCH_BYTES = 1_000_000
PIECE_BYTES = 200_000
_SPACE_RUN = re.compile(r"[ \t\n\r\x0b\x0c]+")


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file on this machine; called where the encoding runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def counter(name: str):
    """Function from a list of texts to their token counts, for .json (tokenizers) and .model (sentencepiece) files."""
    if name not in _loaded:
        path = name if os.path.exists(name) else tokenizer_path(name)
        if name.endswith(".json"):
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[name] = lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[name] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
    return _loaded[name]


def splits_safely(name: str) -> bool:
    """Whether encoding a text is encoding the parts between its white space.

    True for vocabularies that drop white space and never merge across it; a piece model marks word starts
    and depends on what precedes a part, so its texts stay whole.
    """
    return name.endswith("word_bpe_49k.json")


def pieces(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """Cut a long text into parts of about limit characters at runs of ASCII white space; a run without any stays whole."""
    out, a = [], 0
    while len(text) - a > limit:
        m = _SPACE_RUN.search(text, a + limit)
        if not m:
            break
        out.append(text[a : m.start()])
        a = m.end()
    out.append(text[a:])
    return out


def _count(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = counter(name)
        cut = splits_safely(name)
        for batch in batches:
            for a, b in slices(batch.column("text"), BATCH_BYTES):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if cut and any(len(t) > PIECE_BYTES for t in texts):
                    counts = []
                    for t in texts:
                        n, held, size = 0, [], 0
                        for p in pieces(t):
                            held.append(p)
                            size += len(p)
                            if size >= BATCH_BYTES:
                                n += sum(lengths(held))
                                held, size = [], 0
                        counts.append(n + (sum(lengths(held)) if held else 0))
                else:
                    counts = lengths(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])
        release()

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: (id_col, n_bytes long, n_tokens long, over_limit boolean).

    Arrow functions return lengths only. Batches are balanced by bytes, and texts above PIECE_BYTES are
    encoded in parts cut at white space where the vocabulary allows it. A null text counts as empty (0
    tokens); null or repeated ids keep a row each; an empty table gives none; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    out = map_arrow(src, _count(tokenizer), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
