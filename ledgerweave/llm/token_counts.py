"""Token counts with a digest cache: only texts never counted before meet the tokenizer.

The cache is a Parquet folder of (version, content, n_tokens), where content is the SHA-256 of
a text and version that of the tokenizer's file and library. Digests of all rows are joined to
the stored counts; of those without one, one row per distinct content fetches its text, is
encoded, and its count is appended. Then every row takes its count from the cache.

Copies are one row before texts move, so a text with a third of all rows is encoded once. The
one shuffle of texts is of the misses alone. The last join has plain shuffles on both sides, so
AQE splits a content with very many rows. A worker splits texts into the pattern's pieces and
lets the library encode each distinct piece once; texts that hold a special token, and
tokenizers with other rules, go to the library whole.

Defined results: null is an empty text, which has no tokens; rows that repeat a doc_id, with
the same text or another, get the counts of their own texts; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.arrays import block_hashes, flat, pieces, sums_by
from ledgerweave.llm.pretokens import split
from ledgerweave.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces a worker remembers.
KEPT = 120_000
CACHE = "version binary, content binary, n_tokens long"


class Counter:
    """Counts of one tokenizer, with the pieces this worker has met."""

    def __init__(self, model: bytes, json_file: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json_file, self.known = json_file, {}
        self.special: list[bytes] = []
        self.by_piece = False
        if json_file:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(model.decode("utf-8"))
            self.library.no_truncation()
            self.library.no_padding()
            rules = json.loads(model)
            self.special = [t["content"].encode() for t in rules.get("added_tokens") or []]
            before = rules.get("pre_tokenizer") or {}
            self.by_piece = (
                before.get("type") == "ByteLevel"
                and not before.get("add_prefix_space")
                and before.get("use_regex", True)
                and not rules.get("normalizer")
            )
        else:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def whole(self, texts: list[str]) -> list[int]:
        if self.json_file:
            return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(e) for e in self.library.encode(texts, num_threads=1)]

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n, data = len(offsets) - 1, buf.tobytes()
        if not self.by_piece:
            return np.array(self.whole([data[a:b].decode() for a, b in zip(offsets, offsets[1:])]), np.int64)
        starts, ends, owner = split(buf, offsets)
        if not len(starts):
            return np.zeros(n, np.int64)
        keys = block_hashes(buf, starts, ends)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        texts = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        counts = sums_by(owner, self._of_pieces(texts)[which], n)
        if any(s in data for s in self.special):
            for i in range(n):
                text = data[offsets[i] : offsets[i + 1]]
                if any(s in text for s in self.special):
                    counts[i] = self.whole([text.decode()])[0]
        return counts

    def _of_pieces(self, texts: list[bytes]) -> np.ndarray:
        found = [self.known.get(t) for t in texts]
        new = [i for i, c in enumerate(found) if c is None]
        if new:
            if len(self.known) + len(new) > KEPT:
                self.known.clear()
            for i, c in zip(new, self.whole([texts[i].decode() for i in new])):
                found[i] = c
                if len(texts[i]) < 64 and len(self.known) < KEPT:
                    self.known[texts[i]] = c
        return np.array(found, np.int64)


_counters: dict[bytes, Counter] = {}


def counter(model: bytes, json_file: bool) -> Counter:
    key = hashlib.sha256(model).digest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(model, json_file)
    return _counters[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def version_of(model: bytes, json_file: bool) -> bytes:
    """A digest of all that a count depends on besides the text."""
    import sentencepiece
    import tokenizers

    library = f"tokenizers {tokenizers.__version__}" if json_file else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(library.encode() + b"\0" + model).digest()


def encode_counts(texts: DataFrame, model: bytes, json_file: bool) -> DataFrame:
    """``content`` and ``n_tokens`` for rows of ``content`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model, json_file)
        for batch in batches:
            for part in pieces(batch, "text"):
                counts = own.counts(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(counts)], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def counted(documents: DataFrame, cache: str | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``cache`` is a shared folder.

    Without ``cache`` a new one is begun in the session's shared folder. One job at a time may
    append to a cache; counts found twice are taken once.
    """
    spark = documents.sparkSession
    path = path or default_path()
    with open(path, "rb") as file:
        model = file.read()
    json_file = path.endswith(".json")
    version = F.lit(version_of(model, json_file))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    digests = cut_lineage(rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")))
    if cache is None:
        cache = f"{spark.sparkContext.getCheckpointDir()}/token-counts-{uuid.uuid4().hex}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version).select("content", "n_tokens")

    first = digests.groupBy("content").agg(F.min("doc_id").alias("one"))
    misses = first.join(stored(), "content", "left_anti").withColumnRenamed("content", "missing")
    # The small side is built into hash tables, so that the texts need no sort.
    wanted = (F.col("content") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("one"))
    texts = rows.join(misses.hint("shuffle_hash"), wanted, "left_semi")
    new = encode_counts(texts, model, json_file).dropDuplicates(["content"])
    new.select(version.alias("version"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = cut_lineage(stored().dropDuplicates(["content"]))
    return digests.join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op7_digest_cache_counts(spark, sf_dir: str) -> DataFrame:
    """Counts with a cache of its own, so that each call does all of the work."""
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
