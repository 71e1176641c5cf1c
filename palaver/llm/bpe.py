"""Byte-level BPE: overlapping chunks are cut into pre-tokens, stitched, and encoded.

A text of up to ``chunk_chars`` code points is a single chunk: its boundaries are sure and there is
nothing to stitch, so it is encoded where it lies. A longer one is cut into chunks that overlap;
tasks pre-tokenise the chunks side by side, each from its own start. The start may lie
inside a pre-token, so a chunk's first boundaries can be wrong; the pattern looks only ahead, so
from the first boundary that a chunk shares with its predecessor both agree. There the chunks are
stitched, and tasks encode the stitched pieces side by side.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import small_batches

#: Code points of a chunk, and what it reads beyond its end.
CHUNK_CHARS, OVERLAP_CHARS = 65_536, 4_096
#: Pre-tokens a worker remembers.
CACHE = 400_000
#: Pieces of more bytes than this are merged with a heap.
LONG_PIECE = 48
#: Code points beyond a pre-token's begin that decide whether it is a contraction ('re, 've, 'll).
AHEAD = 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens and decimal ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[x] for x in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge_piece in n log n: a linked list of parts and a heap of pairs."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: it was merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Coder(dict):
    """Pre-token to its ids as decimal text, joined by commas; decode() turns such text into bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.cut = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.bytes_of = {str(v): k for k, v in ranks.items()}

    def __missing__(self, piece: str) -> str:
        ids = ",".join(map(str, merge_piece(piece.encode("utf-8"), self.ranks)))
        if len(self) >= CACHE:
            self.clear()
        self[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> str:
        return ",".join([self[p] for p in pieces])

    def decode(self, ids: str) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in ids.split(",")]) if ids else b""


_CODERS: dict[int, _Coder] = {}


def _coder(ranks, pattern: str) -> _Coder:
    """One coder for each Python worker and broadcast, so that its cache outlives a task."""
    if ranks.value["id"] not in _CODERS:
        _CODERS.clear()
        _CODERS[ranks.value["id"]] = _Coder(ranks.value["ranks"], pattern)
    return _CODERS[ranks.value["id"]]


def sure_bounds(pattern: regex.Pattern, text: str, start: int, last: bool) -> list[int]:
    """Boundaries, counted from the text's begin, that a chunk's own reading gives.

    A pre-token that touches the end of what the chunk reads could go on there, and an apostrophe
    just before it could begin a contraction; so the last ends are left out unless the chunk is the
    last.
    """
    ends = [start + m.end() for m in pattern.finditer(text)]
    while not last and ends and ends[-1] > start + len(text) - AHEAD:
        ends.pop()
    return [start, *ends]


def stitch(pattern: regex.Pattern, text: str, bounds: list[list[int]]) -> list[int]:
    """All true boundaries of a text from those of its overlapping chunks.

    From a boundary that the chunk before has proved true, a chunk that has it too is right. While
    none is shared, as when one pre-token spans the overlap, the text is cut one pre-token onwards.
    """
    true = [0]
    for own in bounds:
        known = set(own)
        while true[-1] not in known and true[-1] < own[-1]:
            true.append(pattern.match(text, true[-1]).end())
        if true[-1] in known:
            at = true[-1]
            true += [b for b in own if b > at]
    while true[-1] < len(text):
        true.append(pattern.match(text, true[-1]).end())
    return true


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _whole(ranks, pattern: str) -> Callable:
    """Encode and decode texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            ns, shas, backs = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(coder.cut(text))
                ns.append(ids.count(",") + 1 if ids else 0)
                shas.append(_sha(ids.encode()))
                backs.append(_sha(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], schema=_OUT)

    return run


def _pretokens(pattern: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(pattern)
        for pdf in batches:
            pdf["bounds"] = [sure_bounds(compiled, *x) for x in zip(pdf.chunk, pdf.start, pdf["last"], strict=True)]
            pdf["chunk"] = [t[:n] for t, n in zip(pdf.chunk, pdf.own, strict=True)]
            yield pdf[["doc_id", "text_key", "start", "chunk", "bounds"]]

    return run


def _stitched(pattern: str, chunk_chars: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        text = "".join(pdf.chunk)
        true = stitch(regex.compile(pattern), text, [list(b) for b in pdf.bounds])
        rows, begin = [], 0
        for i in range(1, len(true)):
            if i + 1 == len(true) or true[i + 1] - true[begin] > chunk_chars:
                rows.append((pdf.doc_id.iloc[0], pdf.text_key.iloc[0], len(rows), text[true[begin] : true[i]], [b - a for a, b in zip(true[begin:i], true[begin + 1 : i + 1])]))
                begin = i
        out = pd.DataFrame(rows, columns=["doc_id", "text_key", "part", "text", "lengths"])
        return out.astype({"doc_id": "Int64"})

    return run


def _pieces(ranks, pattern: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(ranks, pattern)
        for pdf in batches:
            ids = []
            for text, lengths in zip(pdf.text, pdf.lengths, strict=True):
                pieces, at = [], 0
                for n in lengths:
                    pieces.append(text[at : at + n])
                    at += n
                ids.append(coder.encode(pieces))
            pdf["ids"], pdf["decoded"] = ids, [coder.decode(x) for x in ids]
            yield pdf[["doc_id", "text_key", "part", "ids", "decoded"]]

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Encode each text, decode the ids, and return digests of both.

    Returns doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256. A null
    text counts as empty: no ids, and the digest of nothing. Repeated rows and null ids give one
    row each. Other columns are not read. The vocabulary file is read on the driver and broadcast;
    its size is that of the vocabulary, whatever the input.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = load_ranks(ranks_path)
    ranks = spark.sparkContext.broadcast({"id": hash((ranks_path, len(vocabulary), pattern)), "ranks": vocabulary})
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk_chars
    short = docs.where(~long).mapInArrow(_whole(ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    # Equal rows are encoded once and given back as often as they were there.
    texts = docs.where(long).groupBy("doc_id", F.sha2("text", 256).alias("text_key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    chunks = (
        texts.select("doc_id", "text_key", "text", F.length("text").alias("n"), F.explode(F.expr(f"sequence(0, length(text) - 1, {chunk_chars})")).alias("start"))
        .select("doc_id", "text_key", "start", F.substring("text", F.col("start") + 1, F.lit(chunk_chars + overlap_chars)).alias("chunk"), F.lit(chunk_chars).alias("own"), (F.col("start") + chunk_chars + overlap_chars >= F.col("n")).alias("last"))
        .repartition("doc_id", "text_key", "start")
    )
    key = "doc_id long, text_key string"
    parts = (
        chunks.mapInPandas(_pretokens(pattern), f"{key}, start int, chunk string, bounds array<int>")
        .groupBy("doc_id", "text_key")
        .applyInPandas(_stitched(pattern, chunk_chars), f"{key}, part int, text string, lengths array<int>")
        .repartition("doc_id", "text_key", "part")
        .mapInPandas(_pieces(ranks, pattern), f"{key}, part int, ids string, decoded binary")
    )
    joined = parts.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("part", "ids", "decoded"))).alias("parts"))
    ids = F.array_join("parts.ids", ",")
    whole = joined.select(
        "doc_id",
        "text_key",
        F.regexp_count(ids, F.lit(",")).cast("long").alias("commas"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.unhex(F.array_join(F.transform("parts.decoded", F.hex), "")), 256).alias("decoded_sha256"),
    )
    copies = texts.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "copies")
    whole = whole.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("doc_id", (F.col("commas") + 1).alias("n_tokens"), "ids_sha256", "decoded_sha256", F.explode(F.expr("sequence(1, int(copies))")).alias("copy")).drop("copy")
    return short.unionByName(whole)


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where the installed vocabulary of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by the multi-language byte-level vocabulary."""
    import public_tokenizers

    from palaver.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.PATTERN)
