"""Token ids of whole texts with a public tokenizer.

Texts of up to ``CHUNK`` characters are encoded as they are. Longer ones are cut into chunks that
overlap; every chunk is pre-tokenised on its own, neighbours are stitched at the first pre-token
boundary of the overlap that both have (from there on both read the text alike), and the pieces
between stitches are encoded in parallel. Where an overlap has no common boundary (one endless
word), its two chunks stay one piece. Decoding concatenates the tokens' raw bytes.

A piece model has no pre-tokens; where none of its pieces holds a line break (which the model is asked), nothing is
merged across one, and long texts are cut before line breaks instead. A line is never cut, so one endless line is the
work of one task, and so is a text of a model whose pieces hold line breaks.

Defined cases: null and empty texts have an empty list; strings that look like special tokens are
ordinary text; texts of blanks have the ids of the blanks; repeated texts have equal ids; an empty
table gives none.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary files lie, on every executor.
FOLDER = "/opt/tokenizers"
#: Characters in a chunk, and further ones that it shares with the next.
CHUNK, OVERLAP = 16_384, 1_024
# Fixed value: the pre-token pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def byte_bpe(name: str, folder: str):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def piece_model(name: str, folder: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))


@lru_cache(maxsize=1)
def pre_token():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=4)
def parted_by_lines(name: str, folder: str) -> bool:
    """Whether a piece model reads what begins with a line break alike with and without the text before it."""
    m = piece_model(name, folder)
    alone = not any("\n" in m.id_to_piece(i) for i in range(m.get_piece_size()))
    tried = [("x", "\ny"), ("x ", "\n\n  y"), ("  x\t", "\n y z")]
    return alone and all(m.encode(a + b) == m.encode(a) + _after_start(m, b) for a, b in tried)


def _after_start(model, text: str) -> list[int]:
    """Ids of what follows in a longer text: without the blank that the model puts before a text's beginning."""
    return model.encode(text)[1:]


def encoder(name: str, folder: str = FOLDER) -> Callable[[str], list[int]]:
    """Text to ids, for one of the tokenizers with a .tiktoken or .model file."""
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        return byte_bpe(name, folder).encode_ordinary
    return piece_model(name, folder).encode


def decode(ids: list[int], name: str, folder: str = FOLDER) -> str:
    """The text of ids: their raw bytes, one after the other."""
    return b"".join(byte_bpe(name, folder).decode_tokens_bytes(ids)).decode("utf-8")


def boundaries(chunk: str, lo: int, hi: int, from_start: bool) -> list[int]:
    """Ends of pre-tokens in [lo, hi) of a chunk that a piece may end at.

    The character before must not be white space: then the piece's last pre-token ends there with
    or without what follows. An end at the chunk's own end is no evidence. Unless reading begins at
    the chunk's start, it begins where white space follows something else, which is a boundary
    whatever came before; without such a place nothing is certain, and there are no ends.
    """
    out = []
    at = 0
    if not from_start:
        m = pre_token_break().search(chunk, max(0, lo - 4 * OVERLAP), lo)
        if not m:
            return out
        at = m.start()
    for m in pre_token().finditer(chunk, at):
        e = m.end()
        if e >= hi or e >= len(chunk) - 1:
            break
        if e >= lo and not chunk[e - 1].isspace():
            out.append(e)
    return out


@lru_cache(maxsize=1)
def pre_token_break():
    import regex

    return regex.compile(r"(?<=\S)\s")


def _chunk_info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk the boundaries, as places in the text, in its head and in its tail."""
    for b in batches:
        heads, tails = [], []
        for k, text in zip(b.column("k").to_pylist(), b.column("chunk").to_pylist()):
            base = k * CHUNK
            heads.append([base + e for e in boundaries(text, 1, OVERLAP, True)] if k else [])
            tails.append([base + e for e in boundaries(text, CHUNK + 1, CHUNK + OVERLAP, False)] if len(text) > CHUNK else [])
        ints = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, ints), pa.array(tails, ints)], names=[*b.schema.names, "head", "tail"])


def _encode(batches: Iterator[pa.RecordBatch], keys: int, name: str, folder: str, count: bool, follows: bool = False) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text, by its ids or their number. With ``follows`` pieces but the first (0) follow others at a line break."""
    encode = encoder(name, folder)
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        kept = b.columns[:keys]
        if follows:
            model, number = piece_model(name, folder), b.column("piece").to_pylist()
            coded = [(_after_start(model, t) if k else encode(t)) if t else [] for k, t in zip(number, texts)]
            last = pa.array([len(c) for c in coded], pa.int64()) if count else pa.array(coded, pa.list_(pa.int32()))
        elif count:
            last = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
        else:
            flat, ends = array("i"), np.zeros(len(texts) + 1, np.int32)
            for i, t in enumerate(texts):
                if t:
                    flat.extend(encode(t))
                ends[i + 1] = len(flat)
            last = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([*kept, last], names=[*b.schema.names[:keys], "ids"])


def _pieces(long: DataFrame, key: str) -> DataFrame:
    """key, piece (number), text: pieces of long texts that can be encoded one by one."""
    spread = F.expr(f"sequence(0, CAST((length(text) - 1) div {CHUNK} AS INT))")
    chunks = long.select(key, "text", F.explode(spread).alias("k")).select(key, "k", F.expr(f"substring(text, k * {CHUNK} + 1, {CHUNK + OVERLAP})").alias("chunk"))
    key_type = long.schema[key].dataType.simpleString()
    seen = chunks.repartition(key, "k").mapInArrow(_chunk_info, f"`{key}` {key_type}, k int, chunk string, head array<long>, tail array<long>")
    w = Window.partitionBy(key).orderBy("k")
    begin = F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))
    stitched = seen.withColumn("begin", begin).withColumn("end", F.lead("begin").over(w))
    base = F.col("k") * CHUNK
    start = F.coalesce("begin", base)
    stop = F.coalesce("end", base + CHUNK)
    part = F.substring(F.col("chunk"), (start - base + 1).cast("int"), (stop - start).cast("int"))
    numbered = stitched.select(key, "k", part.alias("part"), F.count("begin").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))
    return numbered.groupBy(key, "piece").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("x")).select(key, "piece", F.expr("array_join(transform(x, e -> e.part), '')").alias("text"))


def _line_pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """key, piece (number), text: texts cut before the first line break after each ``CHUNK`` characters."""
    for b in batches:
        rows, number, parts = [], [], []
        for i, t in enumerate(b.column("text").to_pylist()):
            at, k = 0, 0
            while at < len(t):
                end = t.find("\n", at + CHUNK)
                end = len(t) if end < 0 else end
                rows.append(i)
                number.append(k)
                parts.append(t[at:end])
                at, k = end, k + 1
        yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(number, pa.int64()), pa.array(parts, pa.string())], names=[key, "piece", "text"])


def encode_texts(docs: DataFrame, key: str, text: str, name: str, *, folder: str = FOLDER, count: bool = False) -> DataFrame:
    """key, ids (array of int); with ``count`` key, tokens (long)."""
    byte_level = os.path.exists(os.path.join(folder, f"{name}.tiktoken"))
    whole = not byte_level and not parted_by_lines(name, folder)
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    key_type = rows.schema[key].dataType.simpleString()
    result = "long" if count else "array<int>"
    is_long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    short = rows if whole else rows.where(~is_long)
    out = short.mapInArrow(lambda it: _encode(it, 1, name, folder, count), f"`{key}` {key_type}, ids {result}")
    if not whole:
        long = rows.where(is_long)
        pieces = _pieces(long, key) if byte_level else long.mapInArrow(lambda it: _line_pieces(it, key), f"`{key}` {key_type}, piece long, text string")
        coded = pieces.repartition(key, "piece").mapInArrow(lambda it: _encode(it, 2, name, folder, count, not byte_level), f"`{key}` {key_type}, piece long, ids {result}")
        if count:
            joined = coded.groupBy(key).agg(F.sum("ids").alias("ids"))
        else:
            joined = coded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("x")).select(key, F.expr("flatten(transform(x, e -> e.ids))").alias("ids"))
        out = out.unionByName(joined)
    return out.withColumnRenamed("ids", "tokens") if count else out
