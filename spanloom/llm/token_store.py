"""Content-addressed store of token ids.

Every document's ids, with an end id, are cut into chunks where a rolling hash of the last ids says so, so that
equal passages give equal chunks wherever they stand. The store holds

    chunks/   digest, n, data      each different chunk once; data is the zstd-compressed ids
    recipes/  doc_id, start, ...   each document's chunk digests and Merkle root, in files of ascending doc_id
    manifest/ part, n_docs, ...    for each recipe file its number of ids and the hash of its documents' roots
    count/    n_docs               how many documents the store was given

Ids are little-endian, 2 bytes wide where the vocabulary allows and else 4. Reading checks every chunk against
its digest, every document's root against its recipe, every file's root against the manifest and the number of
documents against that of the input, and puts the documents' CRC-32 together from those of their chunks, so that no chunk has to travel to its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import counted_join, delete, new_path, small_batches, table, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids in a chunk: at least, on average (a power of two) beyond that, at most.
LEAST, SPACING, MOST = 256, 1024, 8192
#: Ids that the rolling hash sees.
SPAN = 8
#: Words, and parts of words, whose ids a worker remembers; and texts whose chunks a task remembers.
MEMO, TEXTS = 800_000, 20_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A word of Latin letters and then marks, whose normal form and pre-tokens are plain: the letters in lower case, and the marks.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=>?@[-`{-~]*)")


#: Fixed values of a tokenizer file with which the ids of a text are those of its words (see WordEncoder): how it normalises, how it finds pre-tokens, and how its model ends words.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "truncation": None,
    "padding": None,
}


def by_word(path: str) -> bool:
    """Whether the tokenizer file at path is one whose texts can be encoded word by word: BY_WORD holds, and each added token has a `<`, by which texts that may hold one are told, and no white space, and is no plain word."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model = d["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
    own = all("<" in a["content"] and not a["normalized"] and not a["single_word"] and not a["lstrip"] and not a["rstrip"] and not re.search(r"\s", a["content"]) and not PLAIN.fullmatch(a["content"]) for a in d["added_tokens"])
    return plain and own and all(d.get(k) == v for k, v in BY_WORD.items())


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, and else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder(dict):
    """Ids (as little-endian 32-bit numbers) of words, worked out when first asked for; a worker keeps it from task to task.

    Word by word gives the ids of whole texts where by_word() holds: pre-tokens never reach over white space, and how
    a character is normalised depends on none beyond it. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        self.tok, self.by_word = tokenizer(path), by_word(path)
        self.model, self.letters, self.pieces = self.tok.model, byte_letters(), {}
        self.raw = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]

    def piece(self, text: str) -> bytes:
        got = self.pieces.get(text)
        if got is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            got = b"".join([self.raw[t.id] for t in self.model.tokenize(shown)])
            if len(self.pieces) < MEMO:
                self.pieces[text] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        plain = PLAIN.fullmatch(text)
        if plain:
            got = self.piece(plain[1].lower())
            if plain[2]:
                got += self.piece(plain[2])
        else:
            got = b"".join([self.raw[i] for i in self.tok.encode(text, add_special_tokens=False).ids])
        if len(self) < MEMO:
            self[word] = got
        return got

    def ids(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        if not self.by_word:
            return np.array(self.tok.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4").tobytes()
        # lower case comes first but where an added token may stand, which is found as it is written
        return b"".join(map(self.__getitem__, (text if b"<" in text else text.lower()).split()))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def mixed(ids: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit number for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def cuts(ids: np.ndarray, least: int = LEAST, spacing: int = SPACING, most: int = MOST) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= least:
        return [n] if n else []
    g = mixed(ids)
    h = g.copy()
    for j in range(1, SPAN):
        h[j:] += g[:-j] << np.uint64(j)
    marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(spacing) == 0) + 1
    out, last = [], 0
    for m in marks.tolist():
        if m - last < least:
            continue
        while m - last > most:
            last += most
            out.append(last)
        if m - last >= least and m < n:
            out.append(m)
            last = m
    while n - last > most:
        last += most
        out.append(last)
    out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node moves up as it is; leaves and inner nodes have different prefixes."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


#: _SHIFTS[n] is x to the power 32 * n, in the same terms: what n ids after it do to a CRC.
_SHIFTS = [1 << 31, 1 << 31]
for _ in range(32):
    _SHIFTS[1] = (_SHIFTS[1] >> 1) ^ (0xEDB88320 if _SHIFTS[1] & 1 else 0)


def _shift(n_bytes: int) -> int:
    if n_bytes % 4 or n_bytes > 4 * (1 << 20):
        half = n_bytes // 2
        return _times(_shift(half), _shift(n_bytes - half)) if n_bytes > 1 else (1 << 23 if n_bytes else 1 << 31)
    while len(_SHIFTS) <= n_bytes // 4:
        _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[1]))
    return _SHIFTS[n_bytes // 4]


def joined_crc(parts) -> int:
    """CRC-32 of the concatenation of parts, each given as (CRC-32, bytes)."""
    out = 0
    for crc, n_bytes in parts:
        out = _times(_shift(n_bytes), out) ^ crc
    return out


STAGED = "kind string, key binary, n int, data binary, doc_id string, n_tokens long, digests array<binary>, lengths array<int>, root binary"


def write_store(docs: DataFrame, place: str, path: str | None = None, end_id: int = END_ID, least: int = LEAST, spacing: int = SPACING, most: int = MOST) -> None:
    """Encodes each row of docs (doc_id, text) and writes the store under place.

    Null texts count as empty; each document has at least the end id. Repeated rows each get a recipe, and share
    their chunks; of rows with equal (or null) ids the order is that of their Merkle roots. Null ids come first.
    Other columns are ignored; an empty table gives an empty store.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    small_batches(spark)

    def chunked(batches):
        import zstandard
        from pyspark import TaskContext

        enc, squeeze, seen, texts = word_encoder(path), zstandard.ZstdCompressor(level=1), set(), {}
        part, row = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        wide = enc.tok.get_vocab_size() > 1 << 16
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                known = hashlib.blake2b(text, digest_size=16).digest()
                recipe = texts.get(known)
                if recipe is None:
                    ids = np.frombuffer(enc.ids(text) + end, "<u4")
                    digests, lengths, at = [], [], 0
                    for to in cuts(ids, least, spacing, most):
                        raw = ids[at:to].astype("<u4" if wide else "<u2").tobytes()
                        digest = hashlib.sha256(raw).digest()
                        if digest not in seen:
                            if len(seen) < 1_000_000:
                                seen.add(digest)
                            rows.append(("chunk", digest, to - at, squeeze.compress(raw), None, None, None, None, None))
                        digests.append(digest)
                        lengths.append(to - at)
                        at = to
                    recipe = (len(ids), digests, lengths, merkle(digests))
                    if len(texts) < TEXTS:
                        texts[known] = recipe
                # no two rows share it, so that grouping by it merges no recipes
                spread = hashlib.sha256(f"{part} {row}".encode()).digest()
                row += 1
                rows.append(("recipe", spread, 0, None, doc_id, *recipe))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in STAGED.split(", ")]).astype({"n_tokens": "Int64"})

    # an id goes as text, as beside nulls whole numbers would become floats
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = source.mapInPandas(chunked, STAGED).repartition("kind", "key")
    rest = ["n", "doc_id", "n_tokens", "digests", "lengths", "root"]
    once = rows.groupBy("kind", "key").agg(F.first(F.struct(*rest)).alias("r"), F.min("data").alias("data"), F.max("data").alias("same"))
    # chunks with one digest must be equal byte by byte
    data = F.when(F.col("data").eqNullSafe(F.col("same")), F.col("data")).otherwise(F.raise_error(F.lit("two chunks with one digest")).cast("binary"))
    once.select("kind", "key", data.alias("data"), *[f"r.{c}" for c in rest]).write.partitionBy("kind").option("compression", "uncompressed").parquet(f"{place}/staged")

    recipes = spark.read.schema(STAGED).parquet(f"{place}/staged").where("kind = 'recipe'").select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "digests", "lengths", "root")

    def numbered(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, row, before = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column("n_tokens").to_numpy()
            ends = before + np.cumsum(sizes)
            more = {"part": pa.array(np.full(len(sizes), part, np.int32)), "row": pa.array(np.arange(row, row + len(sizes))), "within": pa.array(ends - sizes)}
            for name, values in more.items():
                b = b.append_column(name, values)
            yield b
            row, before = row + len(sizes), int(ends[-1]) if len(sizes) else before

    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.mapInArrow(numbered, RECIPE).write.parquet(f"{place}/recipes")
    delete(spark, f"{place}/staged/kind=recipe")
    part_roots(recipes_of(spark, place)).write.parquet(f"{place}/manifest")
    # how many documents there have to be
    docs.agg(F.count("*").alias("n_docs")).coalesce(1).write.parquet(f"{place}/count")


RECIPE = "doc_id long, n_tokens long, digests array<binary>, lengths array<int>, root binary, part int, row long, within long"


def recipes_of(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{place}/recipes")


def part_roots(recipes: DataFrame) -> DataFrame:
    """One row a recipe file: number of documents and of ids, the SHA-256 of its documents' roots in order (so that a task holds one root at a time)."""

    def roots(batches):
        state, part, docs, ids = hashlib.sha256(), None, 0, 0
        for b in batches:
            for p, r, n in zip(b["part"], b["root"], b["n_tokens"], strict=True):
                if part is not None and p != part:
                    yield pd.DataFrame([(part, docs, ids, state.digest())], columns=["part", "n_docs", "n_ids", "root"])
                    state, docs, ids = hashlib.sha256(), 0, 0
                part, docs, ids = p, docs + 1, ids + int(n)
                state.update(r)
        if part is not None:
            yield pd.DataFrame([(part, docs, ids, state.digest())], columns=["part", "n_docs", "n_ids", "root"])

    return recipes.select("part", "row", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "row").mapInPandas(roots, "part int, n_docs long, n_ids long, root binary")


def read_chunks(spark: SparkSession, place: str) -> DataFrame:
    """digest, n, crc (of the ids as 32-bit) and ok (the digest is that of the data) of each stored chunk."""
    chunks = spark.read.schema(STAGED).parquet(f"{place}/staged").where("kind = 'chunk'").select("key", "n", "data")

    def check(batches):
        import zstandard

        undo = zstandard.ZstdDecompressor()
        for b in batches:
            raw = [undo.decompress(x) for x in b["data"]]
            ids = [np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4").astype("<u4") for r, n in zip(raw, b["n"], strict=True)]
            yield pd.DataFrame({"digest": b["key"], "n": b["n"], "crc": [zlib.crc32(i.tobytes()) for i in ids], "ok": [hashlib.sha256(r).digest() == k for r, k in zip(raw, b["key"], strict=True)]})

    return chunks.mapInPandas(check, "digest binary, n int, crc long, ok boolean")


def read_store(spark: SparkSession, place: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of each document, from the files alone. Where documents are missing, none is verified."""
    small_batches(spark)
    recipes = recipes_of(spark, place)
    parts = spark.read.schema("part int, n_docs long, n_ids long, root binary").parquet(f"{place}/manifest")
    found = part_roots(recipes).select("part", F.col("n_docs").alias("docs_found"), F.col("n_ids").alias("ids_found"), F.col("root").alias("root_found"))
    given = spark.read.schema("n_docs long").parquet(f"{place}/count").first()["n_docs"]
    kept = found.agg(F.coalesce(F.sum("docs_found"), F.lit(0)).alias("n")).first()["n"]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: as many as the store has recipe files.
    starts = parts.join(found, "part", "left").select(
        "part",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("part_start"),
        (F.lit(given == kept) & F.col("root").eqNullSafe(F.col("root_found")) & F.col("n_docs").eqNullSafe(F.col("docs_found")) & F.col("n_ids").eqNullSafe(F.col("ids_found"))).alias("part_ok"),
    )
    entries = recipes.select("part", "row", F.posexplode(F.arrays_zip("digests", "lengths")).alias("pos", "entry")).select("part", "row", "pos", F.col("entry.digests").alias("digest"), F.col("entry.lengths").alias("length"))
    # that of an empty document, and boilerplate, are in very many recipes; a chunk that is missing leaves its documents without a root
    used = entries.groupBy("digest").agg(F.count("*").alias("uses"))
    chunks = written(used.join(read_chunks(spark, place), "digest"), "store-chunks")
    entries = counted_join(entries, chunks, ["digest"], "uses")
    parts_of = entries.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "crc", "length", (F.col("ok") & (F.col("n") == F.col("length"))).alias("ok"), "digest"))).alias("p"))
    parts_of = parts_of.select("part", "row", F.transform("p", lambda x: x["crc"]).alias("crcs"), F.transform("p", lambda x: x["length"]).alias("lengths"), F.transform("p", lambda x: x["digest"]).alias("digests"), F.coalesce(F.forall("p", lambda x: x["ok"]), F.lit(False)).alias("all_ok"))

    docs = recipes.drop("digests", "lengths").join(parts_of, ["part", "row"], "left").join(starts, "part")

    def whole(batches):
        for b in batches:
            crcs, good = [], []
            for n, root, crc, lengths, digests, ok in zip(b["n_tokens"], b["root"], b["crcs"], b["lengths"], b["digests"], b["all_ok"] & b["part_ok"], strict=True):
                crc, lengths, digests = ([] if x is None else x for x in (crc, lengths, digests))
                crcs.append(int(crc[0]) if len(crc) == 1 else joined_crc(zip(map(int, crc), (4 * int(x) for x in lengths), strict=True)))
                good.append(bool(ok) and merkle(list(digests)) == root and sum(lengths) == n)
            yield pd.DataFrame({"doc_id": b["doc_id"], "start": b["part_start"] + b["within"], "n_tokens": b["n_tokens"], "ids_crc32": crcs, "verified": good})

    columns = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "n_tokens", "root", "within", "crcs", "lengths", "digests", F.coalesce("all_ok", F.lit(False)).alias("all_ok"), "part_start", F.coalesce("part_ok", F.lit(False)).alias("part_ok"))
    return columns.mapInPandas(whole, "doc_id string, start long, n_tokens long, ids_crc32 long, verified boolean").withColumn("doc_id", F.col("doc_id").cast("long"))


def read_ids(spark: SparkSession, place: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids (array of int, with the end id) of the documents in doc_ids (doc_id), put together from their chunks."""
    chosen = recipes_of(spark, place).join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    entries = chosen.select("part", "row", "doc_id", F.posexplode("digests").alias("pos", "key"))
    chunks = spark.read.schema(STAGED).parquet(f"{place}/staged").where("kind = 'chunk'").select("key", "n", "data")
    parts = entries.join(chunks, "key").groupBy("part", "row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "data"))).alias("parts"))

    def whole(batches):
        import zstandard

        undo = zstandard.ZstdDecompressor()
        for b in batches:
            ids = []
            for parts in b["parts"]:
                raw = [(undo.decompress(p["data"]), p["n"]) for p in parts]
                ids.append(np.concatenate([np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4") for r, n in raw]).astype(np.int32).tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids})

    return parts.select(F.col("doc_id").cast("string").alias("doc_id"), "parts").mapInPandas(whole, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    place = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), place)
    return read_store(spark, place)
