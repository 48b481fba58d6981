"""Training-order materialisation: token ids in fixed-stride shards, in the order of a keyed Feistel permutation.

1. Texts are tokenised with a public vocabulary (``vocabulary``: a rank file, its path is a parameter) and end with ``end``. They are
   cut into units where the vocabulary cuts too; of some megabytes of texts each different unit is tokenised once. The ids
   are written once to the shared folder, a long text in pieces of ``PIECE`` ids.
2. In the order of id and text hash the texts are one stream of ids, which is cut into sequences of ``length`` ids: only the last
   sequence can be shorter. A text's place in the stream is a running total over one narrow row per text. Rows equal in id and hash
   have equal ids, so the stream does not depend on which of them comes first.
3. A Feistel network over the next even number of bits permutes the index of a sequence, keyed by ``key``; it walks the cycle until
   the result is below the number of sequences. Each sequence so has one global slot and each slot one sequence, whatever their number.
4. The places of the texts go to one small file per stored partition, which the task that reads the partition looks them up in and
   cuts its texts at the ends of sequences. One shuffle by ranges of whole shards brings the pieces to their shards, sorted; the task
   that writes a shard puts them together. Ids are stored once and shuffled once, each piece packed with a dictionary that is trained
   on the starts of about ``SAMPLE`` texts (a bounded sample that decides sizes, never results). The last sequence is padded with ``pad``, so slot s
   is at byte (s mod ``per_shard``) * stride of shard s div ``per_shard``: reads are sequential and can start anywhere.

The order depends on key and rows only, not on files, partitions or timing. ``write_shards`` writes a file per shard under another
name and moves it, so a shard is whole or absent. A shard that is there stays only if its bytes have the digest of the shard to be
written, else it is replaced: a broken run is taken up again, and orders are never mixed. ``materialised`` writes all shards and gives
the rows with the payloads as read back from them; it is an error if the folder then holds shards beyond the last one.

Defined cases. Null and empty texts are the end id alone. Repeated rows are texts of their own, ids may be null. An empty table
gives no sequence. A text of any length fills as many sequences as it needs. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, filesystem, put_file, raw_texts, shared_folder, stored
from tidemark.operators.ordering import dense_index, running

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how the public vocabulary cuts texts before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROUNDS = 6
# Longest part of a text that is tokenised at once; cuts fall before a blank.
PART = 1 << 16
# Most ids of a text in one stored row.
PIECE = 1 << 16
# Bytes of texts whose units are looked up at once (a longer text by itself).
LOOKED_UP = 1 << 23
SHARDS_PER_TASK = 16
# Texts whose starts make the dictionary (twice as many at most), its bytes, and the levels of packing.
SAMPLE = 4096
DICTIONARY = 1 << 18
LEVEL = 5
STORED_LEVEL = 6
PLACES = "slot bigint, shard bigint, offset bigint, sequence bigint, doc_ids array<bigint>, lengths array<int>, n int"


@dataclass(frozen=True)
class Settings:
    vocabulary: str = VOCABULARY
    end: int = 50256
    pad: int = 50256
    length: int = 512
    per_shard: int = 8192
    key: int = 20_260_101
    partitions: int | None = None

    @property
    def stride(self) -> int:
        return 2 * self.length


def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str, size: int = PART) -> list[str]:
    """Parts of a long text; a cut falls before a single blank between words, where the vocabulary cuts too."""
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


def _followed() -> np.ndarray:
    """Whether the vocabulary always cuts between a byte and the next one, as a flat table of 256 rows.

    It does behind an ASCII letter or digit and any other kind of ASCII character, and in front of whitespace that follows none.
    """
    kinds = np.array([*range(256)])
    space, letter, digit = np.isin(kinds, [*range(9, 14), 32]), np.char.isalpha(_CHARS), np.char.isdigit(_CHARS)
    kind = np.select([space, letter, digit, kinds >= 128], [0, 1, 2, 4], 3)
    ends = np.isin(kind, [1, 2])[:, None] & (kind != 4) & (kind[:, None] != kind)
    return (ends | (space & ((kinds > 32) & (kinds != 127))[:, None])).ravel()


_CHARS = np.array([chr(x) if x < 128 else "" for x in range(256)])
_FOLLOWED = _followed()
# first bytes of the characters beyond ASCII that may be whitespace
_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def cuts(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """Whether texts are cut before these places (from 1) in any case. Behind characters that may be whitespace the answer is no."""
    last = data[:-1] if isinstance(at, slice) else data[at - 1]
    found = _FOLLOWED[last.astype(np.uint16) << 8 | (data[1:] if isinstance(at, slice) else data[at])]
    wide = np.flatnonzero(found & (last >= 128))
    place = wide + 1 if isinstance(at, slice) else at[wide]
    found[wide] = (data[np.maximum(place - 2, 0)] != 0xC2) & ~_LEADS[data[np.maximum(place - 3, 0)]]
    return found


def units(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the units of some texts begin that can be tokenised by themselves.

    ``data`` has the texts' bytes one after the other, ``ends`` where each of them ends.
    """
    begins = np.append(np.append(True, cuts(data, slice(1, None))), False)
    begins[ends] = True
    return np.flatnonzero(begins[:-1])


class UnitEncoder:
    """Ids of texts; each different unit of the texts given at once is tokenised once."""

    def __init__(self, settings: Settings):
        vocabulary = encoder(settings.vocabulary)
        if max(vocabulary.max_token_value, settings.end, settings.pad) >> 16:
            raise ValueError("ids must fit 16 bits")
        self.encode = vocabulary.encode_to_numpy
        self.bytes = np.zeros(vocabulary.max_token_value + 1, np.int64)
        for token in vocabulary.token_byte_values():
            self.bytes[vocabulary.encode_single_token(token)] = len(token)

    def learned(self, different: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of each unit. Units that can stand behind each other are tokenised as one text: it is cut between them in any case."""
        edges = np.frombuffer(different.buffers()[1], "<i8", len(different) + 1)
        data = np.frombuffer(different.buffers()[2], np.uint8, edges[-1])
        at = edges[1:-1]
        apart = ~cuts(data, at)
        # and about PART bytes at once
        apart |= np.diff(edges[1:] // PART, prepend=0)[1:] > 0
        stops = [*at[apart].tolist(), len(data)]
        found, start = [], 0
        for stop in stops:
            found += [self.encode(p, disallowed_special=()) for p in parts_of(data[start:stop].tobytes().decode())]
            start = stop
        ids = np.concatenate(found)
        after = np.append(0, np.cumsum(self.bytes[ids]))
        offsets = 2 * np.searchsorted(after, edges).astype("<i8")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(different), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each of the texts."""
        ends = np.cumsum([len(x) for x in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            yield from (np.empty(0, "<u2") for _ in texts)
            return
        begins = units(data, ends)
        edges = np.append(begins, len(data)).astype("<i8")
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        ids = self.learned(own.dictionary).take(own.indices)
        after = np.frombuffer(ids.buffers()[1], "<i8", len(begins) + 1) // 2
        ids = np.frombuffer(ids.buffers()[2], "<u2", after[-1])
        start = 0
        for stop in after[np.searchsorted(begins, ends)]:
            yield ids[start:stop]
            start = stop


def tokens(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(partition, number, doc_id, hash, at, total, ids) of every text's pieces; ids are little-endian 16-bit numbers.

    ``number`` counts the texts of a partition, ``at`` the ids of the text before the piece, ``total`` all of the text's.
    """
    schema = pa.schema([("partition", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.int64()), ("total", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode = UnitEncoder(settings).texts
        partition, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0

        def out():
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            doc_ids, texts, digests = batch.column(0).to_pylist(), raw_texts(batch.column(1)), batch.column(2).to_pylist()
            for low, high in chunks(texts, LOOKED_UP):
                for doc_id, own, digest in zip(doc_ids[low:high], encode(texts[low:high]), digests[low:high], strict=True):
                    ids = np.append(own, np.array([settings.end], "<u2"))
                    for k in range(0, len(ids), PIECE):
                        own = ids[k : k + PIECE]
                        rows.append((partition, number, doc_id, digest, k, len(ids), own.tobytes()))
                        held += own.nbytes
                    number += 1
                if held > 1 << 22:
                    yield out()
                    rows, held = [], 0
        yield out()

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint"), text, F.xxhash64(text).alias("hash")).mapInArrow(
        run, "partition bigint, number bigint, doc_id bigint, hash bigint, at bigint, total bigint, ids binary"
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of every number (the finaliser of SplitMix64; its two factors and three shifts are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The place of each index in the keyed permutation of 0..n-1.

    The network's domain has fewer than 4n values, so a walk takes four steps on average; it ends, as the cycle comes back to the
    index itself.
    """
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mixed(np.uint64(key % (1 << 64)) ^ np.arange(1, ROUNDS + 1, dtype=np.uint64) << np.uint64(48))

    def network(x):
        left, right = x >> width, x & mask
        for k in keys:
            left, right = right, left ^ (_mixed(right ^ k) & mask)
        return left << width | right

    out = network(np.asarray(index).astype(np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = network(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def _write_starts(placed: DataFrame, folder: str) -> None:
    """One file per partition of the stored ids: where in the stream each of its texts starts, eight bytes each."""

    def run(batches):
        open_part, starts = None, []

        def close():
            data = np.concatenate(starts).astype("<i8").tobytes()
            put_file(posixpath.join(folder, f"starts-{open_part:08d}"), lambda out: out.write(data))
            return pa.RecordBatch.from_arrays([pa.array([open_part], pa.int64())], ["partition"])

        for batch in batches:
            parts, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])[: len(parts)]:
                end = np.searchsorted(parts, parts[at], "right")
                if parts[at] != open_part:
                    if open_part is not None:
                        yield close()
                    open_part, starts = int(parts[at]), []
                starts.append(found[at:end])
        if open_part is not None:
            yield close()

    dealt = placed.repartition("partition").sortWithinPartitions("partition", "number").select("partition", "start")
    dealt.mapInArrow(run, "partition bigint").count()


def _cut(kept: DataFrame, folder: str, n: int, dictionary: bytes, settings: Settings) -> DataFrame:
    """(slot, sequence, first, begins, doc_id, ids): the stored texts cut at the ends of sequences.

    ``ids`` are packed. ``first`` is the place in the sequence, ``begins`` is true for the start of a text. A task reads the starts of its own
    partitions only, so the ids are not shuffled to find their place.
    """
    schema = pa.schema([("slot", pa.int64()), ("sequence", pa.int64()), ("first", pa.int32()), ("begins", pa.bool_()), ("doc_id", pa.int64()), ("ids", pa.binary())])
    size = settings.length

    def run(batches):
        held, starts = None, None
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_learned(dictionary), write_dict_id=False).compress
        for batch in batches:
            sequences, firsts, begins, ids_of, own = [], [], [], [], []
            for part, number, doc_id, at, ids in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if part != held:
                    store, path = filesystem(posixpath.join(folder, f"starts-{part:08d}"))
                    with store.open_input_file(path) as file:
                        held, starts = part, np.frombuffer(file.read(), "<i8")
                place = int(starts[number]) + at
                low, begin = 0, at == 0
                while low < len(ids):
                    sequence, first = divmod(place, size)
                    high = min(len(ids), low + 2 * (size - first))
                    sequences.append(sequence)
                    firsts.append(first)
                    begins.append(begin)
                    ids_of.append(doc_id)
                    own.append(pack(ids[low:high]))
                    place, low, begin = place + (high - low) // 2, high, False
            slots = permuted(np.array(sequences, np.int64), n, settings.key)
            columns = [slots, sequences, firsts, begins, ids_of, own]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return kept.select("partition", "number", "doc_id", "at", "ids").mapInArrow(
        run, "slot bigint, sequence bigint, first int, begins boolean, doc_id bigint, ids binary"
    )


@dataclass(frozen=True)
class Pieces:
    """The pieces of all sequences (see ``_cut``), the number of sequences, and the dictionary that the ids are packed with."""

    rows: DataFrame
    n: int
    dictionary: bytes


def _dictionary(kept: DataFrame, texts: int, settings: Settings) -> bytes:
    """Trained on the starts of some texts, picked by their place in the stored table; empty where they are too few or too alike."""
    chosen = F.pmod(F.xxhash64("partition", "number"), F.lit(max(1, texts))) < SAMPLE
    starts = kept.where("at = 0").where(chosen).select(F.substring("ids", 1, settings.stride).alias("ids")).limit(2 * SAMPLE)
    samples = [bytes(r["ids"]) for r in starts.collect()]
    try:
        # a dictionary needs several times its size to learn from
        size = min(DICTIONARY, sum(map(len, samples)) // 8)
        return zstandard.train_dictionary(size, samples).as_bytes() if size > 1024 else b""
    except zstandard.ZstdError:
        return b""


def _learned(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pieces(docs: DataFrame, settings: Settings = Settings()) -> Pieces:
    kept = stored(tokens(docs, settings), "tokens", level=STORED_LEVEL)
    narrow = kept.where("at = 0").select("partition", "number", "doc_id", "hash", "total")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"), F.col("partition"), F.col("number")]
    placed = dense_index(narrow, order, "_index").select("partition", "number", "total", "_index")
    placed = running(placed, F.col("total"), "start", inclusive=False, index="_index")
    folder = shared_folder(docs.sparkSession, "starts")
    _write_starts(placed.select("partition", "number", "start"), folder)
    size = narrow.agg(F.count(F.lit(1)).alias("texts"), F.sum("total").alias("ids")).first()
    n, dictionary = -(-(size["ids"] or 0) // settings.length), _dictionary(kept, size["texts"], settings)
    return Pieces(_cut(kept, folder, n, dictionary, settings), n, dictionary)


def _whole(batches, dictionary: bytes, settings: Settings) -> Iterator[tuple]:
    """(slot, sequence, documents, lengths, n, payload) from batches of pieces sorted by slot and place."""
    at, sequence, docs, lengths, parts, size = None, None, [], [], [], 0
    unpack = zstandard.ZstdDecompressor(dict_data=_learned(dictionary)).decompress

    def padded():
        payload = b"".join(parts)
        pad = int(settings.pad).to_bytes(2, "little") * (settings.length - size)
        return at, sequence, docs, lengths, size, payload + pad

    for batch in batches:
        for slot, number, first, begins, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
            if slot != at:
                if at is not None:
                    yield padded()
                at, sequence, docs, lengths, parts, size = slot, number, [], [], [], 0
            if first != size:
                raise ValueError(f"slot {slot} has {size} ids before a piece at {first}")
            ids = unpack(ids)
            if begins or not docs:
                docs.append(doc_id)
                lengths.append(0)
            lengths[-1] += len(ids) // 2
            size += len(ids) // 2
            parts.append(ids)
    if at is not None:
        yield padded()


def _place(whole: tuple, settings: Settings) -> tuple:
    slot, sequence, docs, lengths, n, _ = whole
    return slot, slot // settings.per_shard, slot % settings.per_shard * settings.stride, sequence, docs, lengths, n


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
_NAMES = [x.split()[0] for x in PLACES.split(", ")]


def _batch(rows: list[tuple], payloads: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ARROW, strict=True)]
    more = [] if payloads is None else [pa.array(payloads, pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, *more], _NAMES + ["payload"] * len(more))


def ordered(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(slot, shard, offset, sequence, doc_ids, lengths, n, payload) of every sequence, in slot order within range partitions.

    ``doc_ids`` are the documents in a sequence, in order, ``lengths`` how many of its ``n`` ids each has.
    """
    every = pieces(docs, settings)
    dictionary = every.dictionary

    def run(batches):
        held, payloads = [], []
        for whole in _whole(batches, dictionary, settings):
            held.append(_place(whole, settings))
            payloads.append(whole[-1])
            if len(held) == 1024:
                yield _batch(held, payloads)
                held, payloads = [], []
        if held:
            yield _batch(held, payloads)

    parts = [settings.partitions] if settings.partitions else []
    return every.rows.repartitionByRange(*parts, "slot").sortWithinPartitions("slot", "first").mapInArrow(run, f"{PLACES}, payload binary")


def _dealt(rows: DataFrame, n: int, settings: Settings) -> DataFrame:
    """``rows`` in ranges of whole shards, one to a partition. The number of shards is known: no sample is taken."""
    shards = -(-n // settings.per_shard)
    least = settings.partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(shards, max(least, -(-shards // SHARDS_PER_TASK))))
    shard = F.floor(F.col("slot") / settings.per_shard)
    return rows.repartitionById(ranges, F.floor(shard * ranges / max(1, shards)).cast("int"))


def _digest(store, path: str) -> bytes:
    digest = hashlib.sha256()
    with store.open_input_file(path) as shard:
        for part in iter(lambda: shard.read(1 << 20), b""):
            digest.update(part)
    return digest.digest()


def write_shards(every: Pieces, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write the sequences of ``pieces`` as ``shard-000000.bin`` and so on; their places, as in ``ordered``.

    Shards that are there with the same bytes stay.
    """
    n, dictionary = every.n, every.dictionary

    def run(batches):
        open_shard, out, part, digest, expected = None, None, None, None, None
        held = []

        def begin(shard):
            nonlocal open_shard, out, part, digest, expected
            store, path = filesystem(posixpath.join(folder, f"shard-{shard:06d}.bin"))
            store.create_dir(posixpath.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            open_shard, out, digest, expected = shard, store.open_output_stream(part), hashlib.sha256(), shard * settings.per_shard

        def close():
            out.close()
            if expected != min(n, (open_shard + 1) * settings.per_shard):
                raise ValueError(f"shard {open_shard} lacks sequences from slot {expected} on")
            store, path = filesystem(posixpath.join(folder, f"shard-{open_shard:06d}.bin"))
            if store.get_file_info(path).is_file and _digest(store, path) == digest.digest():
                store.delete_file(part)
            else:
                store.move(part, path)

        for whole in _whole(batches, dictionary, settings):
            place = _place(whole, settings)
            if place[1] != open_shard:
                if open_shard is not None:
                    close()
                begin(place[1])
            if place[0] != expected:
                raise ValueError(f"slot {expected} is missing")
            out.write(whole[-1])
            digest.update(whole[-1])
            expected += 1
            held.append(place)
            if len(held) == 4096:
                yield _batch(held)
                held = []
        if open_shard is not None:
            close()
        if held:
            yield _batch(held)

    return _dealt(every.rows, n, settings).sortWithinPartitions("slot", "first").mapInArrow(run, PLACES)


def read_shards(places: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """``places`` (as of ``write_shards``) with the payload that the shards hold for each slot."""

    def run(batches):
        name, shard = None, None
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):  # a megabyte of payloads at 512 ids
                part = batch.slice(low, 1024)
                payloads = []
                for number, offset in zip(part.column("shard").to_pylist(), part.column("offset").to_pylist(), strict=True):
                    if number != name:
                        if shard is not None:
                            shard.close()
                        store, path = filesystem(posixpath.join(folder, f"shard-{number:06d}.bin"))
                        name, shard = number, store.open_input_file(path)
                    shard.seek(offset)
                    payload = shard.read(settings.stride)
                    if len(payload) != settings.stride:
                        raise ValueError(f"shard {number} ends before byte {offset + settings.stride}")
                    payloads.append(payload)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary())], [*part.schema.names, "payload"])
        if shard is not None:
            shard.close()

    return places.mapInArrow(run, f"{PLACES}, payload binary")


def materialised(docs: DataFrame, settings: Settings = Settings(), folder: str | None = None) -> DataFrame:
    """The rows of ``ordered``, written as shards to ``folder`` (a fresh one of the shared store by default) and read back."""
    from pyarrow import fs

    folder = folder or shared_folder(docs.sparkSession, "shards")
    every = pieces(docs, settings)
    places = stored(write_shards(every, folder, settings), "places")
    store, path = filesystem(folder)
    there = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    named = [x.base_name for x in there if x.base_name.startswith("shard-") and x.base_name.endswith(".bin")]
    if len(named) != -(-every.n // settings.per_shard):
        raise ValueError(f"{folder} holds shards of another order beyond the last one")
    return read_shards(_dealt(places, every.n, settings).sortWithinPartitions("slot"), folder, settings)


def read_slot(folder: str, slot: int, settings: Settings = Settings()) -> np.ndarray:
    """The padded ids of one slot, read at its place in its shard."""
    store, path = filesystem(posixpath.join(folder, f"shard-{slot // settings.per_shard:06d}.bin"))
    with store.open_input_file(path) as shard:
        shard.seek(slot % settings.per_shard * settings.stride)
        return np.frombuffer(shard.read(settings.stride), "<u2")
