"""SentencePiece ids by a table of distinct chunks, and their decoding.

A chunk is a run of white-space markers with the text up to the next marker. No piece of the model has a marker after
another character, so no merge crosses the start of a chunk and every chunk can be segmented by itself. Documents become
blocks of chunk numbers and a list of the block's distinct chunks. The lists meet by hash range, where each distinct chunk
is segmented once; its ids go back to the blocks that hold it, and every document takes its ids by position. Rows are
packed and compressed, since a row for every occurrence, or for every chunk of a block, would outweigh the texts. Blocks
are cut twice, once for the lists and once for the numbers, rather than written in between; a block's name is a hash of its
texts, so both passes give it the same one.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.registry import query, table
from pursuit.llm.words import pieces

MARK = "▁"
BLOCK_BYTES = 32 << 20      # text of a block; a longer document is a block of its own
SLICE_CODES = 1 << 19       # chunk numbers of a row; a longer document is a row of its own
KNOWN = 1 << 20             # segmented chunks a task remembers; one beyond them is segmented again
LISTS = "block binary, part int, chunks binary"
NUMBERS = "block binary, part int, doc_ids array<long>, sizes array<int>, codes binary"
IDS = "block binary, part int, ids binary"
ENCODED = "doc_id long, ids array<int>, decoded string"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(planes.T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()


def pack_texts(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    sizes = np.array([len(raw), *map(len, raw)], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(raw))


def unpack_texts(data: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    starts = np.append(4 * (n + 1), ends[:-1])
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, which is the one that the library puts before a text."""
    if not text:
        return []
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, gap = [], 0
    for i, part in enumerate(parts):  # an empty part is a marker that belongs to what follows
        if part or i == len(parts) - 1:
            out.append(" " * gap + part)
            gap = 0
        else:
            gap += 1
    return out


def numbering(names: list[str], flat: np.ndarray, parts: int):
    """The names of a block by part and falling frequency in ``flat``, where each part begins, and the final number of each
    old one: a common name has a small number."""
    names = np.array(names, object)
    part = (pd.util.hash_array(names, categorize=False) % np.uint64(parts)).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    order = np.lexsort((-np.bincount(flat, minlength=len(names)), part))
    first = np.searchsorted(part[order], np.arange(parts + 1))
    code = np.empty(len(names), np.int64)
    code[order] = (np.arange(len(names)) - first[part[order]]) * parts + part[order]
    return names[order], first, code


class Block:
    """Documents in the order they came in, as numbers of the block's distinct chunks."""

    def __init__(self):
        self.number_of: dict[str, int] = defaultdict()
        self.number_of.default_factory = self.number_of.__len__
        self.docs: list[tuple] = []
        self.held, self.texts = 0, hashlib.blake2b(digest_size=16)

    def add(self, doc_id, text: str, raw: bytes) -> None:
        found = chunks(text)
        self.docs.append((doc_id, np.fromiter(map(self.number_of.__getitem__, found), np.int64, len(found))))
        self.held += len(raw)
        self.texts.update(len(raw).to_bytes(8, "big") + raw)

    def ordered(self, parts: int):
        return numbering(list(self.number_of), np.concatenate([c for _, c in self.docs]), parts)

    def lists(self, parts: int):
        """One row for each part that has chunks."""
        names, first, _ = self.ordered(parts)
        key = self.texts.digest()
        for p in np.flatnonzero(np.diff(first)).tolist():
            yield key, p, pack_texts(names[first[p]:first[p + 1]].tolist())

    def numbers(self, parts: int):
        """One row for each run of documents; runs are numbered downwards from -1, so that they sort after parts."""
        _, _, code = self.ordered(parts)
        key, lo = self.texts.digest(), 0
        while lo < len(self.docs):
            hi, size = lo, 0
            while hi < len(self.docs) and (hi == lo or size + len(self.docs[hi][1]) <= SLICE_CODES):
                size += len(self.docs[hi][1])
                hi += 1
            taken = self.docs[lo:hi]
            codes = pack(code[np.concatenate([c for _, c in taken])])
            yield key, -1 - lo, [i for i, _ in taken], [len(c) for _, c in taken], codes
            lo = hi


def _blocks(parts: int, rows_of, types):
    """Rows of blocks that are cut by the sizes of the texts alone, whatever batches they come in."""
    def cut(batches):
        block = Block()
        for part, data, offsets in pieces(batches):
            for i, text, a, b in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if block.docs and block.held + b - a > BLOCK_BYTES:
                    yield from (_batch(row, types) for row in rows_of(block, parts))
                    block = Block()
                block.add(i, text, data[a:b].tobytes())
        if block.docs:
            yield from (_batch(row, types) for row in rows_of(block, parts))
    return cut


def _batch(row, types: dict):
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types.values())], names=list(types))


LIST_TYPES = {"block": pa.binary(), "part": pa.int32(), "chunks": pa.binary()}
NUMBER_TYPES = {"block": pa.binary(), "part": pa.int32(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary()}
ID_TYPES = {"block": pa.binary(), "part": pa.int32(), "ids": pa.binary()}


def _segment(path: str):
    """Ids of the chunks of each row, each distinct chunk segmented once as long as ``KNOWN`` of them are held."""
    def segment(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # a chunk that is one marker, of which the library would make two
        lone = {"": np.array([model.piece_to_id(MARK)], np.uint32)}
        known: dict[str, np.ndarray] = dict(lone)
        for batch in batches:
            for block, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                names = unpack_texts(packed)
                new = [n for n in names if n not in known]
                if len(known) + len(new) > KNOWN:
                    known = dict(lone)
                    new = [n for n in names if n]
                known.update(zip(new, (np.array(i, np.uint32) for i in model.encode(new, num_threads=1))))
                found = [known[n] for n in names]
                sizes = np.array([len(names), *map(len, found)], np.uint32)
                yield _batch((block, part, pack(np.concatenate([sizes, *found]))), ID_TYPES)
    return segment


def _assemble(path: str, parts: int):
    """Ids by position. Rows come sorted by block, the ids of its chunks before its documents."""
    def assemble(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        current, lists, ready = None, {}, None

        def ragged():
            """Start and size of the ids of every chunk number of the block, and the ids."""
            top = max((len(s) for s, _ in lists.values()), default=0)
            start, size = np.zeros(top * parts, np.int64), np.zeros(top * parts, np.int64)
            base, out = 0, []
            for p, (sizes, ids) in lists.items():
                at = np.arange(len(sizes)) * parts + p
                size[at] = sizes
                start[at] = base + np.cumsum(sizes) - sizes
                base += len(ids)
                out.append(ids)
            return start, size, np.concatenate(out) if out else np.zeros(0, np.uint32)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current:
                    current, lists, ready = row["block"], {}, None
                if row["ids"] is not None:
                    values = unpack(row["ids"])
                    n = int(values[0])
                    lists[row["part"]] = values[1:n + 1].astype(np.int64), values[n + 1:]
                    continue
                if ready is None:
                    ready = ragged()
                    lists = {}
                start, size, ids = ready
                codes = unpack(row["codes"]).astype(np.int64)
                if codes.max(initial=-1) >= len(size):
                    raise RuntimeError("the documents came in another order when they were read again: write them first")
                n = size[codes]
                ends = np.cumsum(n)
                flat = ids[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)
                chunk_ends = np.cumsum(row["sizes"])
                edges = np.append(0, np.append(0, ends)[chunk_ends]).astype(np.int32)
                texts = [model.decode(flat[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32())), pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "decoded"])
    return assemble


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs``: the ids of its whole text as the library gives them for the
    model file ``path``, without begin and end, and the text that the library's ``decode`` makes of them.

    The model must have no piece with a marker after another character, put one marker before a text, and leave texts
    as they are; other models are refused. A null or empty text has no ids and decodes to an empty text. Rows with equal
    or null ids stay apart; an empty table gives an empty table; other columns are not looked at. ``docs`` are read three
    times, once for their size when called, and must come in the same order, as those of a written table do."""
    _require_separable(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, int(2 * (size / 2 ** 20) ** 0.5))  # distinct chunks grow by less than the text does
    tasks = int(min(20_000, max(8, 2 * size // BLOCK_BYTES)))
    lists = rows.mapInArrow(_blocks(parts, Block.lists, LIST_TYPES), LISTS)
    ids = lists.repartition(parts, "part").mapInArrow(_segment(path), IDS)
    numbers = rows.mapInArrow(_blocks(parts, Block.numbers, NUMBER_TYPES), NUMBERS)
    both = ids.select("*", F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<int>").alias("sizes"),
                      F.lit(None).cast("binary").alias("codes")).unionByName(numbers.withColumn("ids", F.lit(None).cast("binary")))
    return both.repartition(tasks, "block").sortWithinPartitions("block", F.desc("part")).mapInArrow(_assemble(path, parts), ENCODED)


def _require_separable(path: str) -> None:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces_of = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces_of):
        raise ValueError("pieces of this model cross white-space markers")
    if model.encode(" a  b ") != model.encode(f"{MARK}a{MARK}{MARK}b{MARK}") or model.decode(model.encode(" a  b ")) != " a  b ":
        raise ValueError("this model changes white space before it segments")


@query()
def op11_piece_codec(spark, sf_dir):
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
