"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is pre-tokenised where it lies, from its own first
character, which may be the middle of a pre-token; soon its boundaries meet those of the chunk before it. Where
both have a boundary, all later ones agree, as what follows a boundary depends only on what comes after it. A chunk
that doesn't meet the one before it (within a pre-token longer than the overlap) is joined to that one, and the two
are pre-tokenised together until they meet the next. The text is then cut where chunks meet, the pieces are encoded
apart, and their ids (and bytes, when decoding) are put together. A text of at most one chunk is a piece as it is, so
that ordinary documents are never moved.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, table, written

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters in a chunk, and by how many it reaches into the next.
CHUNK = 1 << 15
OVERLAP = 1 << 11


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tiktoken encoding of a rank file; loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def pre_pattern():
    r"""The pre-token pattern with \s spelt as the Unicode property, as the tokenizer's own engine reads it."""
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(text: str, last: bool) -> list[int]:
    """Where pre-tokens of text begin, and its end if it is the text's last chunk. Near a cut end they may be wrong: what a pre-token is depends on one character after it, so of those only the ones before the last two are kept."""
    starts = [m.start() for m in pre_pattern().finditer(text)]
    return [*starts, len(text)] if last else starts[:-2]


def sliced(docs: DataFrame, spans: str, chunk: int, schema: str, make) -> DataFrame:
    """Rows that make(row, text) gives for each entry of the array column spans of docs (text, ...); each text is held once and cut in one pass."""

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            rows, size = [], 0
            for r in b.itertuples(index=False):
                for i, span in enumerate(getattr(r, spans)):
                    rows.append(make(r, i, span))
                    size += len(rows[-1][-1])
                    if size > 1 << 22:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.mapInPandas(run, schema)


LEXED = "key string, first int, last int, head array<long>, tail array<long>"


def lexed(parts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """LEXED of parts (key, first, last, ends, text): boundaries within the overlaps at both ends of the chunks first to last of a text; ends says that the text ends with them."""

    def run(batches):
        for b in batches:
            heads, tails = [], []
            for first, last, ends, text in zip(b["first"], b["last"], b["ends"], b["text"], strict=True):
                at, own = boundaries(text, bool(ends)), (int(last) - int(first) + 1) * chunk
                heads.append([int(first) * chunk + x for x in at if x <= overlap])
                tails.append([int(first) * chunk + x for x in at if x >= own])
            yield b[["key", "first", "last"]].assign(head=heads, tail=tails)

    return parts.mapInPandas(run, LEXED)


def meetings(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, starts: the places, 0 among them, at which the long texts (key, text) can be cut."""
    n = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    part = "key string, first int, last int, ends boolean, text string"

    def cut(r, _i, span):
        first, last = int(span["first"]), int(span["last"])
        return r.key, first, last, last == r.n - 1, r.text[first * chunk : (last + 1) * chunk + overlap]

    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("first"), i.alias("last")))
    parts = sliced(long_docs.select("key", "text", n.alias("n"), single.alias("spans")), "spans", chunk, part, cut)
    state = written(lexed(parts.repartition("key", "first"), chunk, overlap), "bpe-lexed")
    of_doc = Window.partitionBy("key").orderBy("first")
    while True:
        common = F.array_min(F.array_intersect("head", F.lag("tail").over(of_doc)))
        met = state.withColumn("start", F.when(F.col("first") == 0, F.lit(0).cast("long")).otherwise(common))
        met = met.withColumn("run", F.sum(F.col("start").isNotNull().cast("int")).over(of_doc))
        joined = met.groupBy("key", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n")).where("n > 1")
        again = written(joined.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "bpe-again")
        if again.isEmpty():
            return met.groupBy("key").agg(F.sort_array(F.collect_list("start")).alias("starts"))
        # only the texts of runs that don't meet are pre-tokenised again; each round leaves fewer parts
        parts = sliced(long_docs.select("key", "text", n.alias("n")).join(again, "key"), "spans", chunk, part, cut).repartition("key", "first")
        inside = F.exists("spans", lambda s: (F.col("first") >= s["first"]) & (F.col("last") <= s["last"]))
        rest = state.join(again, "key", "left").where(~F.coalesce(inside, F.lit(False))).select(state.columns)
        state = written(rest.unionByName(lexed(parts, chunk, overlap)), "bpe-lexed")


def pieces_of_long(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, doc_id, piece, n, text of the documents (key, doc_id, n, text) that are longer than a chunk: their texts cut where chunks meet."""

    def cut(r, i, start):
        end = int(r.starts[i + 1]) if i + 1 < len(r.starts) else len(r.text)
        return r.key, r.doc_id, i, r.n, r.text[int(start) : end]

    cuts = long_docs.withColumn("doc_id", F.col("doc_id").cast("string")).join(meetings(long_docs, chunk, overlap), "key")
    pieces = sliced(cuts, "starts", chunk, "key string, doc_id string, piece int, n long, text string", cut)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


PIECE = "key string, doc_id long, piece int, n long, ids binary"


def pieces(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """key, doc_id, piece, n, text: the texts of docs (doc_id, text) that are a piece each (key is null), and the pieces of the longer ones.

    Null texts are empty. Rows that are equal in id and text are apart where the text is short; longer ones are
    pieces of one key, and n says how many rows they stand for. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).select(F.lit(None).cast("string").alias("key"), "doc_id", F.lit(0).alias("piece"), F.lit(1).cast("long").alias("n"), "text")
    long = rows.where(F.length("text") > chunk)
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    small_batches(docs.sparkSession)
    long = written(long.groupBy(key.alias("key")).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n")), "bpe-long")
    return short, pieces_of_long(long, chunk, overlap).repartition("key", "piece")


def encode(texts: DataFrame, path: str | None = None) -> DataFrame:
    """pieces() with ids (little-endian unsigned 32-bit) in place of text."""
    path = path or ranks_path()
    small_batches(texts.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = encoding(path)
        for b in batches:
            ids = [enc.encode_to_numpy(t).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield b.drop_columns(["text"]).append_column("ids", pa.array(ids, pa.binary()))

    return texts.mapInArrow(run, PIECE)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encode()'s rows with the raw bytes of each; a document's bytes are those of its pieces one after the other."""
    path = path or ranks_path()
    small_batches(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        enc = encoding(path)
        for b in batches:
            yield b.append_column("raw", pa.array([enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()], pa.binary()))

    return encoded.mapInArrow(run, PIECE + ", raw binary")


def digests(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text); null and empty texts have no ids. Other columns are ignored; an empty table gives an empty result."""
    short, long = (decode(encode(p, path), path) for p in pieces(docs, chunk, overlap))
    one = short.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))

    def joined(batches):
        """The pieces of a document come one after the other; only its digests are held."""
        import pyarrow as pa

        held = None

        def row(h):
            one = [h["doc_id"], h["count"], h["ids"].hexdigest(), h["raw"].hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([x] * h["n"], t) for x, t in zip(one, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for b in batches:
            for key, doc_id, n, ids, raw in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "n", "ids", "raw")), strict=True):
                if held is None or held["key"] != key:
                    if held is not None:
                        yield row(held)
                    held = {"key": key, "doc_id": doc_id, "n": n, "count": 0, "ids": hashlib.sha256(), "raw": hashlib.sha256()}
                held["ids"].update(ids)
                held["raw"].update(raw)
                held["count"] += len(ids) // 4
        if held is not None:
            yield row(held)

    ordered = long.repartition("key").sortWithinPartitions("key", "piece")
    return one.unionByName(ordered.mapInArrow(joined, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
