"""Byte-level BPE of a public tokenizer, by DuckDB recursive queries over the distinct words of a partition.

Texts are cut into words on the JVM side by the tokenizer's pattern. In each partition the distinct words become
token-position rows; a recursive query joins adjacent tokens with the merge table and contracts each word's minimum-rank
pair, leftmost first, until no pair is left; an ordered aggregation gives each word's ids. No word is sent to another
machine, and nothing that grows with the corpus is broadcast: the merge table has a fixed size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Words whose ids a task remembers between batches; more are encoded anew, with the same result.
REMEMBERED_WORDS = 400_000
#: Squared bytes of words that one recursive query takes: it keeps the tokens of every round, and a word has fewer rounds than bytes.
QUERY_WORK = 30_000_000
#: Bytes of a word from which on it is contracted round by round in a table of its own, which holds no round but the last.
LONG_WORD = 2048

_S = r"\p{IsWhite_Space}"
#: The byte-level pattern with white space spelt out, as Java's \s knows ASCII only.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?!\P{{IsWhite_Space}})|{_S}+"

#: One round: of each word in ``s`` that is not done, the tokens after its minimum-rank pair is contracted, leftmost first.
ROUND = """
    SELECT w, p, CASE WHEN taken THEN new_id ELSE t END AS t, best IS NULL AS done
    FROM (
        SELECT w, p, t, best, new_id, taken, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY p) AS gone
        FROM (
            SELECT *, hit AND (i - max(CASE WHEN hit THEN -1 ELSE i END) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING)) % 2 = 1 AS taken
            FROM (
                SELECT *, coalesce(rank = best, false) AS hit
                FROM (
                    SELECT q.w, q.p, q.t, q.i, m.rank, m.new_id, min(m.rank) OVER (PARTITION BY q.w) AS best
                    FROM (
                        SELECT w, p, t, row_number() OVER (PARTITION BY w ORDER BY p) - 1 AS i, lead(t) OVER (PARTITION BY w ORDER BY p) AS r
                        FROM s WHERE NOT done
                    ) q LEFT JOIN merges m ON m.l = q.t AND m.r = q.r
                )
            )
        )
    )
    WHERE NOT gone
"""
CONTRACT = f"""
WITH RECURSIVE s(w, p, t, done) AS (
    SELECT w, p, t, false FROM start
    UNION ALL
    {ROUND}
)
SELECT w, list(t ORDER BY p) AS ids FROM s WHERE done GROUP BY w ORDER BY w
"""


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def read_merges(path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the 256 bytes, and the merge table (left, right, rank, new id) of a byte-level BPE file."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, rows = model["vocab"], []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        rows.append((vocab[left], vocab[right], rank, vocab[left + right]))
    return np.array([vocab[c] for c in byte_alphabet()], dtype=np.int32), np.array(rows, dtype=np.int32).reshape(-1, 4)


class Encoder:
    """Ids of words, by the recursive query; one DuckDB connection in each Python worker."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray):
        import duckdb

        self.byte_ids = byte_ids
        # Without a temporary folder nothing is ever spilled to the machine's own disk.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        table = pa.table({k: pa.array(merges[:, i]) for i, k in enumerate(("l", "r", "rank", "new_id"))})
        self.db.register("merges_in", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.int32)

    def encode(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length, in ``self.ids``, of the ids of each of the distinct ``words``; both arrays have room to grow."""
        texts = words.to_pylist()
        if len(self.known) + len(texts) > REMEMBERED_WORDS:
            self.forget()
        missing = [w for w in texts if w not in self.known]
        if missing:
            self._add(missing)
        at = np.fromiter((self.known[w] for w in texts), dtype=np.int64, count=len(texts))
        return self.starts[at], self.starts[at + 1] - self.starts[at]

    def _add(self, missing: list[str]) -> None:
        raw = [w.encode("utf-8") for w in missing]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        lengths, ids = np.zeros(len(raw), dtype=np.int64), {}
        short = np.flatnonzero(sizes < LONG_WORD)
        lot = np.cumsum(sizes[short] ** 2) // QUERY_WORK
        parts = [short[lot == k] for k in np.unique(lot)]
        for part in parts + [np.array([i]) for i in np.flatnonzero(sizes >= LONG_WORD)]:
            size = sizes[part]
            word = np.repeat(np.arange(len(part), dtype=np.int32), size)
            place = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            token = self.byte_ids[np.frombuffer(b"".join(raw[i] for i in part), dtype=np.uint8)]
            self.db.register("start", pa.table({"w": word, "p": place, "t": token}))
            found = (self._long() if size[0] >= LONG_WORD else self.db.sql(CONTRACT)).to_arrow_table().column("ids").combine_chunks()
            self.db.unregister("start")
            if isinstance(found, pa.ChunkedArray):
                found = pa.concat_arrays(found.chunks)
            lengths[part] = np.diff(found.offsets.to_numpy())
            ids.update(zip(part.tolist(), np.split(found.flatten().to_numpy().astype(np.int32), found.offsets.to_numpy()[1:-1]), strict=True))
        first, end = len(self.known), self.starts[len(self.known)]
        self.starts = _room(self.starts, first + len(missing) + 1)
        self.starts[first + 1 : first + len(missing) + 1] = end + np.cumsum(lengths)
        self.ids = _room(self.ids, end + lengths.sum())
        self.ids[end : end + lengths.sum()] = np.concatenate([ids[i] for i in range(len(missing))])
        self.known.update(zip(missing, range(first, first + len(missing)), strict=True))

    def _long(self):
        """The ids of one long word; the same rounds as the recursive query, but each takes the place of the one before."""
        self.db.execute("CREATE OR REPLACE TEMP TABLE s AS SELECT w, p, t, false AS done FROM start")
        while True:
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE s2 AS {ROUND}")
            if self.db.execute("SELECT coalesce(bool_and(done), true) FROM s2").fetchall()[0][0]:
                return self.db.sql("SELECT w, list(t ORDER BY p) AS ids FROM s2 GROUP BY w")
            self.db.execute("CREATE OR REPLACE TEMP TABLE s AS SELECT * FROM s2")


def _room(a: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values; doubled, so that growing copies each value a few times only."""
    if size <= len(a):
        return a
    out = np.zeros(max(size, 2 * len(a)), dtype=a.dtype)
    out[: len(a)] = a
    return out


_ENCODER: dict[str, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The encoder of the worker for this tokenizer, told by its contents; another one takes its place."""
    name, byte_ids, merges = shared.value
    if name not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[name] = Encoder(byte_ids, merges)
    return _ENCODER[name]


def _words_of(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Number of words of each row, and the words of all rows, dictionary-encoded."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, pc.list_flatten(column).dictionary_encode()


def _per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row, of which each has ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _shared(spark: SparkSession, path: str):
    byte_ids, merges = read_merges(path)
    name = hashlib.sha256(byte_ids.tobytes() + merges.tobytes()).hexdigest()
    return spark.sparkContext.broadcast((name, byte_ids, merges))


def words(text: Column) -> Column:
    """The words of a text, whole; null for null."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def encode_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; an empty list for empty and null texts.

    One row for each input row, also for repeated keys and a null key. Strings of special tokens are ordinary text.
    """
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            counts, coded = _words_of(batch.column(1))
            start, length = encoder.encode(coded.dictionary)
            code = coded.indices.to_numpy()
            n = length[code]
            ends = np.cumsum(n)
            flat = encoder.ids[np.repeat(start[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.concatenate([[0], np.cumsum(_per_row(n, counts))]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))], names=[key, "ids"])

    return df.select(F.col(key), words(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): the number of ids that ``encode_texts`` gives each row; 0 for empty and null texts."""
    shared = _shared(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            counts, coded = _words_of(batch.column(1))
            _, length = encoder.encode(coded.dictionary)
            yield pa.record_batch([batch.column(0), pa.array(_per_row(length[coded.indices.to_numpy()], counts))], names=[key, "n_tokens"])

    return df.select(F.col(key), words(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")
