"""Byte-level BPE by a global distinct-word shuffle.

Encoding. Each task cuts its rows into chunks of at most ``chunk_bytes`` of text, splits the texts by the
pattern and numbers the chunk's distinct words; a document becomes the list, by position, of these numbers.
The words are shuffled by a hash bucket, in packed rows of one chunk and bucket, so that each distinct word
of the corpus meets in one bucket and is encoded there once; its ids travel back to the chunks, where they
are put together by position. A very common word is there once per chunk, so no word is hot.

Chunks are named by a hash of their texts. Words and documents are cut in two passes over the same rows;
should a pass see other rows (an unstable source), names do not meet and the job fails instead of giving
wrong ids; materialise such a source first.

Decoding joins each id with the token-byte table, whose size is that of the vocabulary, and concatenates.

Rows: null and empty texts have no ids. Repeated rows are encoded alike. Texts are taken whole; one text
longer than ``chunk_bytes`` is a chunk of its own.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.runtime import lean, ship


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _chunks(batches, chunk_bytes: int):
    """Consecutive rows with at most chunk_bytes of text, as one batch."""
    held, size = [], 0

    def close():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        lens = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(lens.tolist()):
            if size and size + n > chunk_bytes:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield close()
                held, size, start = [], 0, i
            size += n
        if start < b.num_rows:
            held.append(b.slice(start))
            size += 1  # a chunk of empty texts is one, too
    if held:
        yield close()


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _name(texts: list[str]) -> int:
    h = xxhash.xxh3_64()
    for t in texts:
        h.update(t.encode() + b"\xff")
    return h.intdigest() - (1 << 63)


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _pack_words(words: list[bytes]) -> bytes:
    body = b"".join(words)
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *map(len, words)], np.uint32).tobytes() + body)


def _unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 * (n + 1)).tolist()
    return [raw[a:z] for a, z in zip([4 * (n + 1), *ends], ends)]


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_bytes: int = 10 << 20, buckets: int | None = None
) -> DataFrame:
    """(key, ids) of every row of ``docs``; ``vocabulary`` is the path of a .tiktoken ranks file, read on the driver.

    The ranks go to the executors with the job. chunk_bytes and the number of word buckets (four times the
    session's shuffle partitions if not given) bound a task's memory.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def finder():
        import regex

        return regex.compile(pattern).findall

    def words(batches):
        find = finder()
        schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])
        for b in _chunks(batches, chunk_bytes):
            texts, seen = [t or "" for t in b.column(1).to_pylist()], {}
            for t in texts:
                seen.update(dict.fromkeys(find(t)))
            own = sorted((xxhash.xxh3_64_intdigest(w) % buckets, w, n) for n, w in enumerate(w.encode() for w in seen))
            name, rows, at = _name(texts), [], 0
            while at < len(own):
                to = at
                while to < len(own) and own[to][0] == own[at][0]:
                    to += 1
                rows.append((own[at][0], name, _pack(np.array([x[2] for x in own[at:to]])), _pack_words([x[1] for x in own[at:to]])))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, schema.types)], schema=schema)

    def texts_(batches):
        find = finder()
        for b in _chunks(batches, chunk_bytes):
            texts, numbers = [t or "" for t in b.column(1).to_pylist()], _Numbers()
            name, get = _name(texts), numbers.__getitem__
            for i in range(0, len(texts), 500):  # a row holds 500 texts
                own = [np.array(list(map(get, find(t))), np.uint32) for t in texts[i : i + 500]]
                flat = np.concatenate(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([b.column(0).slice(i, len(own)).to_pylist()], pa.list_(b.schema.types[0])), pa.array([_pack(np.array([len(x) for x in own]))]), pa.array([_pack(flat)])],
                    ["chunk", "keys", "sizes", "packed"],
                )

    def encode_words(batches):
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})._core_bpe.encode_single_piece
        bucket, known = None, {}
        for b in batches:
            out = []
            for at, numbers, packed in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if at != bucket:  # sorted by bucket: a word's rows follow one another
                    bucket, known = at, {}
                ids = []
                for w in _unpack_words(packed):
                    x = known.get(w)
                    if x is None:
                        x = known[w] = one(w)
                    ids.append(x)
                out.append((numbers, _pack(np.array(list(map(len, ids)))), _pack(np.fromiter(chain.from_iterable(ids), np.uint32))))
            cols = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(c, pa.binary()) for c in cols)], ["chunk", "numbers", "lens", "ids"])

    def assemble(key_, left, right):
        number, length, values = ([_unpack(x) for x in right.column(c).to_pylist()] for c in ("numbers", "lens", "ids"))
        size = sum(map(len, number))
        start, count, base = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        for n, c in zip(number, length):
            if len(n) and int(n.max()) >= size:
                raise RuntimeError("documents changed between the passes of the encoder; materialise them first")
            c = c.astype(np.int64)
            start[n], count[n] = base + np.cumsum(c) - c, c
            base += int(c.sum())
        values = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
        keys, flat, ends = [], [], [np.zeros(1, np.int64)]
        for own_keys, sizes, packed in zip(*(left.column(c).to_pylist() for c in ("keys", "sizes", "packed"))):
            own, cut = _unpack(packed), np.concatenate(([0], np.cumsum(_unpack(sizes), dtype=np.int64)))
            if len(own) and (int(own.max()) >= size or (start[own] < 0).any()):
                raise RuntimeError("documents changed between the passes of the encoder; materialise them first")
            n = count[own]
            upto = np.concatenate(([0], np.cumsum(n)))
            at = np.repeat(start[own] - upto[:-1], n) + np.arange(int(upto[-1]))
            keys += own_keys
            ends.append(ends[-1][-1] + upto[cut[1:]])
            flat.append(values[at])
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
        return pa.table({key: pa.array(keys, left.schema.field("keys").type.value_type), "ids": ids})

    cut = source.mapInArrow(lean(words), "bucket int, chunk long, numbers binary, words binary")
    back = cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(encode_words), "chunk long, numbers binary, lens binary, ids binary")
    rows = source.mapInArrow(lean(texts_), f"chunk long, keys array<{kind}>, sizes binary, packed binary")
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(assemble, f"{key} {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; a null list decodes to null, an unknown id is an error. A column ``out`` is replaced."""
    ship(encoded.sparkSession)
    encoded = encoded.drop(out)
    ranks = load_ranks(vocabulary)
    table = [None] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        table[i] = b
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    at = encoded.columns.index(ids)

    def run(batches):
        tokens = pa.array(shared.value, pa.large_binary())
        for b in batches:
            lists = b.column(at)
            taken = tokens.take(lists.flatten())
            if taken.null_count:
                raise ValueError("an id is not in the vocabulary")
            # the taken bytes lie end to end, so a row is the stretch between its first and last token
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            edges = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
            cut = edges[np.concatenate(([0], np.cumsum(lens)))]
            body = memoryview(taken.buffers()[2] or b"")
            gone = lists.is_null().to_pylist()
            rows = [None if g else bytes(body[x:y]) for g, x, y in zip(gone, cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.binary())], [*b.schema.names, out])

    return encoded.mapInArrow(lean(run), encoded.select("*", F.lit(b"").alias(out)).schema)
