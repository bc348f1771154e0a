"""Token ids in directly addressable codes: any token can be read without decoding those before it.

An id is cut into chunks of 8 bits, low ones first.  Level k holds chunk k of every id that has one, and a bitmap that
says which of them go on to level k + 1.  A rank directory, the number of set bits before each block of 512, turns a
place in one level into a place in the next: ``place' = directory[place // 512] + set bits since then``.

A file of the format is a Parquet table with one row per shard of consecutive documents (by doc_id, then text; nulls
first): ``part, shard, part_start, doc_ids, lengths, n_tokens, codes``.  Spark's writers and readers carry it, so it can
lie in any store.  Repeated rows are kept, null and empty texts are stored as the end id alone, an empty table as no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from densigrid.llm.bpe import Memo, spaced_words
from densigrid.llm.ship import kept, shared_folder, ship

BLOCK = 512
#: Tokens after which a shard is closed (a document is never split).
SHARD_TOKENS = 250_000

#: Bytes of texts that are encoded together, and characters of words that one call of the library gets: both bound memory.
TOGETHER, CALL_CHARS = 4_000_000, 250_000

#: Characters of a text by which rows of one id are parted.
HEAD = 64

SHARDS = "part int, shard int, part_start long, doc_ids array<long>, lengths array<long>, n_tokens long, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Header (levels; entries of each), then for each level: chunks, bitmap, directory.  The last level has no bitmap."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> 8
        on = more > 0
        last = not on.any()
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        counts = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(counts)])[:-1].astype("<u4")
        levels.append((len(rest), (rest & 255).astype(np.uint8).tobytes() + (b"" if last else bits.tobytes() + directory.tobytes())))
        if last:
            break
        rest = more[on]
    return np.array([len(levels), *[n for n, _ in levels]], "<u4").tobytes() + b"".join(b for _, b in levels)


class Codes:
    """Packed ids; ``at`` reads the ids of any places, ``between`` those of a range."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at = np.frombuffer(data, "<u4", n, 4), 4 + 4 * n
        self.levels, self.size = [], int(sizes[0])
        for k, size in enumerate(map(int, sizes)):
            chunk = np.frombuffer(data, np.uint8, size, at)
            at += size
            bits = directory = None
            if k < n - 1:
                blocks = -(-size // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                at += blocks * BLOCK // 8
                directory = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunk, bits, directory))

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level before a place."""
        _, bits, directory = self.levels[level]
        if place // BLOCK >= len(directory):
            return self.levels[level + 1][0].size
        start = place // BLOCK * BLOCK // 8
        upto = np.unpackbits(bits[start : place // 8 + 1], bitorder="little")[: place % BLOCK]
        return int(directory[place // BLOCK]) + int(upto.sum())

    def at(self, places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, np.int64)
        out, alive = np.zeros(len(places), np.uint32), np.arange(len(places))
        for k, (chunk, bits, directory) in enumerate(self.levels):
            out[alive] |= chunk[places].astype(np.uint32) << np.uint32(8 * k)
            if bits is None:
                break
            on = (bits[places >> 3] >> (places & 7)) & 1 == 1
            alive, places = alive[on], places[on]
            places = np.array([self._rank(k, int(p)) for p in places], np.int64)
        return out

    def between(self, start: int, end: int) -> np.ndarray:
        """Levels are read in runs: one rank at each level finds the run's place in the next."""
        if end <= start:
            return np.zeros(0, np.uint32)
        out, alive = np.zeros(end - start, np.uint32), np.arange(end - start)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[alive] |= chunk[start:end].astype(np.uint32) << np.uint32(8 * k)
            if bits is None:
                break
            on = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start] == 1
            alive = alive[on]
            if not len(alive):
                break
            start = self._rank(k, start)
            end = start + len(alive)
        return out


#: A space before which no cut is safe, for Arrow, whose ``\\s`` knows only some of what Python's does.
_ODD = r" (?:[\s\x0B\x1C-\x1F\x{85}\p{Z}]|$)"

#: A word of letters with signs behind them, of letters and signs that are so in every version of Unicode: the vocabulary's
#: pre-tokenizer always parts these.
_STEM = r"^(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<rest>[!-/:-@\[-`{-~]+)$"


def split_words(texts: pa.StringArray) -> pa.ListArray:
    """``spaced_words`` of each text as one list: its beginning, then the words."""
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    if not odd.true_count:
        return plain
    others = pa.array([[first, *words] for first, words in map(spaced_words, texts.filter(odd).to_pylist())], plain.type)
    places = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
    return pa.concat_arrays([plain, others]).take(pa.array(places))


def byte_letters() -> dict[int, str]:
    """Each byte as the character that byte-level vocabularies write for it: itself if it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b if b in seen else 256 + hidden.index(b)) for b in range(256)}


class WordTokens:
    """Token ids by the tokenizers library, which sees each spaced word once while it is remembered.

    The vocabulary's pre-tokenizer never joins what a safe cut parts (see ``bpe.spaced_words``), whatever stands before it:
    so the words of many texts that are not remembered are one text for the library, and a token that begins with a space
    begins a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.joins = self._plain()
        space, vocabulary = byte_letters()[32], self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True
        self.words, self.rests = Memo(lambda w: self._bytes(" " + w), 600_000), Memo(self._bytes, 50_000)

    def _plain(self) -> bool:
        """Does the library see bytes as they are, cut by its own pattern alone?"""
        told = json.loads(self.tokenizer.to_str())
        cut = told["pre_tokenizer"] or {}
        return told["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and all(t["special"] for t in told["added_tokens"])

    def _bytes(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _spaced(self, words: list[str]) -> Iterator[bytes]:
        """The ids of words behind a space: in one call where they have up to CALL_CHARS characters, those that hold spaces alone."""
        start = size = 0
        for end, word in enumerate(words, 1):
            size += len(word) + 1
            if size < CALL_CHARS and end < len(words):
                continue
            run, start, size = words[start:end], end, 0
            text = " " + " ".join(run)
            if not self.joins or text.count(" ") > len(run):
                yield from (self._bytes(" " + word) for word in run)
                continue
            ids = self._ids(text)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(run):
                raise ValueError("the vocabulary joins spaced words")
            data, edges = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            yield from (data[a:b] for a, b in zip(edges, edges[1:]))

    def _looked_up(self, words: pa.StringArray, memo: Memo, make: Callable[[list[str]], Iterator[bytes]]) -> pa.LargeBinaryArray:
        """The ids of each word; every different word is looked up once."""
        words = words.dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(memo.get, distinct))
        new = [word for word, ids in zip(distinct, found) if ids is None]
        old = list(map(memo.old.get, new))
        made = make([word for word, ids in zip(new, old) if ids is None])
        fresh = {word: next(made) if ids is None else ids for word, ids in zip(new, old)}
        memo.keep_all(fresh)
        return pa.array([fresh[word] if ids is None else ids for word, ids in zip(distinct, found)], pa.large_binary()).take(words.indices)

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of words behind a space: of their letters and of the signs behind these, which many words share."""
        if not self.joins:
            return self._looked_up(words, self.words, self._spaced)
        stems, rests = pc.extract_regex(words, _STEM).flatten()
        stems = self._looked_up(pc.coalesce(stems, words), self.words, self._spaced)
        rests = self._looked_up(pc.fill_null(rests, ""), self.rests, lambda new: (self._bytes(rest) if rest else b"" for rest in new))
        return pc.binary_join_element_wise(stems, rests, pa.scalar(b"", pa.large_binary()))

    def encode_column(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        lists = split_words(texts)
        words, starts = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        inner = np.ones(len(words), bool)
        inner[starts[:-1]] = False
        spaced = words.filter(pa.array(inner)).dictionary_encode()
        ids = self._words(spaced.dictionary).take(spaced.indices)
        edges = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // np.dtype(self.kind).itemsize
        flat = np.frombuffer(ids.buffers()[2] or b"", self.kind, edges[-1])
        ends = edges[starts - np.arange(len(starts))].tolist()
        for first, a, b in zip(words.filter(pa.array(~inner)).to_pylist(), ends, ends[1:]):
            yield np.concatenate([self._ids(first), flat[a:b]])

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))


def load(path: str) -> WordTokens:
    return kept(("dac", path), lambda: WordTokens(path))


def encoded(words: WordTokens, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each row (doc_id, text), in order; texts of about TOGETHER bytes are encoded together."""

    def made() -> Iterator[tuple[int | None, np.ndarray]]:
        doc_ids, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
        return zip(doc_ids.to_pylist(), words.encode_column(pc.fill_null(texts, "")))

    held, size = [], 0
    for batch in batches:
        start = 0
        for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 1):
            size += n
            if size >= TOGETHER:
                held.append(batch.slice(start, row - start))
                yield from made()
                held, start, size = [], row, 0
        held.append(batch.slice(start))
    if held:
        yield from made()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode ``text`` of all rows, in order of doc_id over the whole table, and write shards under ``path``."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(vocabulary)
        end = np.array([end_id], words.kind)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, start, ids, doc_ids
            lengths = [len(x) for x in ids]
            row = [part, shard, start, doc_ids, lengths, sum(lengths), pack(np.concatenate(ids))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            shard, start, ids, doc_ids = shard + 1, start + sum(lengths), [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[f.split()[0] for f in SHARDS.split(", ")])

        held = 0
        for doc_id, own in encoded(words, batches):
            ids.append(np.concatenate([own, end]))
            doc_ids.append(doc_id)
            held += len(ids[-1])
            if held >= SHARD_TOKENS:
                held = 0
                yield close()
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("head", F.substring("text", 1, HEAD))
    # Rows of one id, or of none, can be very many: they are parted by how their texts begin.
    ordered = rows.repartitionByRange("doc_id", "head").sortWithinPartitions("doc_id", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).write.mode("overwrite").parquet(path)


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every stored document."""
    ship(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, lengths = Codes(row["codes"]), np.array(row["lengths"], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                ids = memoryview(codes.between(0, codes.size).astype("<u4").tobytes())  # a whole shard is asked for
                crc = [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["part_start"]), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row per written partition: their number is that of tasks, not of documents.
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # The codes stay where they are: only this small list moves, and its size is bounded by the number of partitions.
    return shards.join(F.broadcast(before), "part").select("part_start", "base", "doc_ids", "lengths", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(shards: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, place, id: the ids at wanted places of documents (null outside them), without decoding what is before them.

    Places are looked up by document first, and go to their shard together (at most as many as it has documents and tokens,
    as a repeated wish counts once); so a shard's codes move once.
    """
    ship(shards.sparkSession)
    where = shards.select("part", "shard", F.posexplode("doc_ids").alias("i", "doc_id")).join(places.select("doc_id", F.col("place").cast("long").alias("place")), "doc_id")
    asked = where.groupBy("part", "shard").agg(F.collect_set(F.struct("i", "place")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                starts = np.cumsum(lengths) - lengths
                i, place = (np.array([x[n] for x in row["asked"]], np.int64) for n in ("i", "place"))
                inside = (place >= 0) & (place < lengths[i])
                ids = np.zeros(len(i), np.int64)
                ids[inside] = Codes(row["codes"]).at(starts[i[inside]] + place[inside])
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][k] for k in i], pa.int64()), pa.array(place), pa.array(ids, mask=~inside)], names=["doc_id", "place", "id"])

    rows = shards.select("part", "shard", "doc_ids", "lengths", "codes").join(asked, ["part", "shard"])
    return rows.mapInArrow(run, "doc_id long, place long, id long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(docs.sparkSession.read.parquet(path))
