"""Byte-level BPE encoding and decoding by recursive queries of DuckDB, one database per worker.

A task takes its texts in runs of a quarter megabyte and splits them into pieces by the
tokenizer's pattern. Pieces the worker has not met yet go into DuckDB as rows (piece, position,
token, next position), at first one per byte. The recursive query joins neighbours to the merge
table, takes each piece's leftmost pair of minimum rank, contracts it, and goes on with the
pieces that had a pair until none has. A text's ids are those of its pieces in order. Decoding joins ids to the
vocabulary and aggregates the bytes of a text in the order of positions.

Only distinct pieces of a run are encoded, and about ``KEPT`` of them are remembered, those
asked for lately, as arrays; the rows in DuckDB are bounded by the run. A worker forgets them, and
its database, when a task of another operator follows. There is no shuffle. The vocabulary's bytes travel with the
job (under 1 MB), so executors need no file of the driver's.

Defined results: null text is an empty one, which has no tokens; a text of any length is
encoded whole, where a single piece of n bytes costs n steps of up to n rows; repeated rows
are encoded each; an empty table gives no rows; other columns stay as they are, except those
with the output's names, which are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.arrays import block_hashes, expand, flat, lean, pieces, worker_cache
from ledgerweave.llm.pretokens import split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces a worker remembers, some 15 MB of them.
KEPT = 400_000
#: Bytes of text that a worker encodes or decodes at once, about.
RUN = 1 << 18
#: Merges that one recursive query makes of a piece at most; longer pieces take several queries.
STEPS = 48

CONTRACT = f"""
WITH RECURSIVE t(step, piece, pos, token, next) AS (
  SELECT 0, piece, pos, token, next FROM seed
  UNION ALL
  SELECT t.step + 1, t.piece, t.pos,
         CASE WHEN t.pos = b.best % 4294967296 THEN (b.best // 4294967296)::INT ELSE t.token END,
         CASE WHEN t.pos = b.best % 4294967296 THEN b.beyond ELSE t.next END
  FROM t JOIN (
    SELECT l.piece, min(m.merged * 4294967296 + l.pos) AS best,
           arg_min(r.pos, m.merged * 4294967296 + l.pos) AS gone,
           arg_min(r.next, m.merged * 4294967296 + l.pos) AS beyond
    FROM t l JOIN t r ON r.pos = l.next JOIN merges m ON m.pair = l.token::BIGINT * 4294967296 + r.token
    GROUP BY l.piece
  ) b USING (piece)
  WHERE t.pos <> b.gone AND t.step < {STEPS}
)
SELECT t.piece, t.pos, t.token, t.next, last.step = {STEPS} AS more
FROM t JOIN (SELECT piece, max(step) AS step FROM t GROUP BY piece) last USING (piece, step)
ORDER BY t.pos
"""

DECODE = """
SELECT text, string_agg(v.bytes, '' ORDER BY pos) AS bytes
FROM ids JOIN vocabulary v USING (token) GROUP BY text
"""


class Pieces:
    """Ids of pieces by 128 bits of hash, in arrays: a dictionary takes several times their memory."""

    def __init__(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of the pieces is, and whether it is there at all."""
        if not len(self):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        return at, (self.keys[at] == keys) & (self.checks[at] == checks)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Pieces in rising order of their keys, with their ids one after another."""
        at = np.searchsorted(self.keys, keys)
        begin = len(self.ids) + np.cumsum(length) - length
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.begin, self.length = np.insert(self.begin, at, begin), np.insert(self.length, at, length)
        self.ids = np.concatenate([self.ids, ids])


class Codec:
    """A vocabulary in DuckDB, with what this worker has encoded so far."""

    def __init__(self, ranks: bytes):
        self.ids = {
            base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)
        }
        self.known, self.older = Pieces(), Pieces()
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        merges = array("q")
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                left, right = self.ids.get(token[:i]), self.ids.get(token[i:])
                if left is not None and right is not None:
                    merges.extend((left, right, rank))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        left, right, merged = np.array(merges, np.int64).reshape(-1, 3).T
        made = pa.table({"pair": (left << 32) + right, "merged": merged})
        self.db.register("made", made)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM made")
        self.db.unregister("made")
        words = pa.table({"token": list(self.ids.values()), "bytes": [t.hex() for t in self.ids]})
        self.db.register("words", words)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM words")
        self.db.unregister("words")

    def encode_pieces(
        self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where each piece's begin and how many they are; the pieces' ``keys`` are distinct and rise."""
        checks = block_hashes(buf, starts, ends, 1)
        at, known = self.known.find(keys, checks)
        back, older = self.older.find(keys, checks)
        older &= ~known
        begin, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        begin[known], length[known] = self.known.begin[at[known]], self.known.length[at[known]]
        begin[older], length[older] = self.older.begin[back[older]], self.older.length[back[older]]
        begin[older] += len(self.known.ids)
        rest = np.flatnonzero(~known & ~older)
        texts = [buf[a:b].tobytes() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        whole = [self.ids.get(text) for text in texts]
        new = [i for i, token in enumerate(whole) if token is None]
        ids: list[np.ndarray] = [np.array([token or 0], np.uint32) for token in whole]
        if new:
            letters = np.frombuffer(b"".join(texts[i] for i in new), np.uint8)
            sizes = np.array([len(texts[i]) for i in new], np.int64)
            for i, own in zip(new, self._contract(np.repeat(np.arange(len(new)), sizes), self.single[letters])):
                ids[i] = own
        length[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
        begin[rest] = len(self.known.ids) + len(self.older.ids) + np.cumsum(length[rest]) - length[rest]
        pool = np.concatenate([self.known.ids, self.older.ids, *ids])
        kept = older.copy()
        kept[rest[new]] = True
        kept = np.flatnonzero(kept & (ends - starts < 64))[: KEPT // 2]
        if len(self.known) + len(kept) > KEPT // 2:
            # What was not asked for since the last such change is forgotten.
            self.known, self.older = Pieces(), self.known
        if len(kept):
            self.known.add(keys[kept], checks[kept], pool[expand(begin[kept], length[kept])], length[kept])
        return pool, begin, length

    def _contract(self, piece: np.ndarray, token: np.ndarray) -> list[np.ndarray]:
        """Ids of pieces 0, 1, ..., given as rows in order; ``pos`` counts over all of them."""
        n = int(piece[-1]) + 1
        ended: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        pos = np.arange(len(piece))
        next_ = np.where(np.diff(piece, append=-1) == 0, pos + 1, -1)
        while len(piece):
            rows = {"piece": piece, "pos": pos, "token": token, "next": next_}
            self.db.register("seed", pa.table({k: v.astype(np.int32) for k, v in rows.items()}))
            got = self.db.execute(CONTRACT).fetchnumpy()
            self.db.unregister("seed")
            piece, pos, token, next_ = (np.asarray(got[k]) for k in ("piece", "pos", "token", "next"))
            more = np.asarray(got["more"]).astype(bool)
            over, ids = piece[~more], token[~more].astype(np.uint32)
            cuts = np.flatnonzero(np.diff(over)) + 1
            for p, part in zip(over[np.r_[0, cuts]] if len(over) else (), np.split(ids, cuts)):
                ended[p] = part
            piece, pos, token, next_ = piece[more], pos[more], token[more], next_[more]
        return ended

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end."""
        starts, ends, owner = split(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys = block_hashes(buf, starts, ends)
        keys, first, which = np.unique(keys, return_index=True, return_inverse=True)
        ids, at, lengths = self.encode_pieces(buf, starts[first], ends[first], keys)
        counts = lengths[which]
        tokens = ids[expand(at[which], counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return tokens, before[np.searchsorted(owner, np.arange(len(offsets)))]

    def decode(self, tokens: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        lengths = np.diff(cuts)
        table = pa.table(
            {
                "text": np.repeat(np.arange(len(lengths)), lengths),
                "pos": np.arange(len(tokens)),
                "token": tokens.astype(np.int64),
            }
        )
        self.db.register("ids", table)
        found = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("ids")
        return [bytes.fromhex(found.get(i, "")) for i in range(len(lengths))]


def codec(ranks: bytes) -> Codec:
    """This worker's codec of a vocabulary; tasks that follow one another share it."""
    codecs, key = worker_cache("bpe"), hashlib.sha256(ranks).digest()
    if key not in codecs:
        codecs.clear()
        codecs[key] = Codec(ranks)
    return codecs[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _blobs(tokens: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    data, cuts = tokens.astype("<u4").tobytes(), (cuts * 4).tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with ``tokens``, their ids as little-endian 32-bit numbers, and ``n_tokens``."""
    ranks = read_ranks(path or default_path())
    rest = documents.drop("tokens", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for part in pieces(batch, "text", RUN):
                tokens, cuts = own.encode(*flat(part.column("text")))
                more = [pa.array(_blobs(tokens, cuts), pa.binary()), pa.array(np.diff(cuts))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "tokens", "n_tokens"])

    schema = T.StructType([*rest.schema, T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return rest.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run, "bpe"), schema)


def decoded(encoding: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of ``encoded`` with ``decoded``, the bytes their ``tokens`` stand for."""
    ranks = read_ranks(path or default_path())
    rest = encoding.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for part in pieces(batch, "tokens", RUN):
                buf, offsets = flat(part.column("tokens"))
                texts = own.decode(np.frombuffer(buf.tobytes(), "<u4"), offsets // 4)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return rest.mapInArrow(lean(run, "bpe"), T.StructType([*rest.schema, T.StructField("decoded", T.BinaryType())]))


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and digests of the ids and of the bytes decoded from them.

    Encoding and decoding in one pass: nothing but digests leaves the worker.
    """
    ranks = read_ranks(path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            for part in pieces(batch, "text", RUN):
                tokens, cuts = own.encode(*flat(part.column("text")))
                columns = [
                    part.column("doc_id"),
                    pa.array(np.diff(cuts)),
                    pa.array([hashlib.sha256(b).hexdigest() for b in _blobs(tokens, cuts)], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in own.decode(tokens, cuts)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run, "bpe"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_duckdb_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
