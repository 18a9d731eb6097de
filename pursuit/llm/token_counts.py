"""Token counts by pre-tokens, without materialising ids.

A document's length in tokens is the sum over its distinct pre-tokens of frequency times pieces, because merges never
cross a pre-token. Documents become blocks: the block's distinct pre-tokens, and per document the numbers of its own ones
with their frequencies. The distinct pre-tokens of all blocks meet by hash range, where the tokenizer counts the pieces of
each once; the counts go back to the blocks that hold them, meet the frequencies and are summed. Rows are packed and
compressed, since a row for every document and pre-token would outweigh the texts.
"""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.piece_codec import numbering, pack, pack_texts, unpack, unpack_texts
from pursuit.llm.registry import query, table
from pursuit.llm.words import pieces
from pursuit.staging import staged

KNOWN_BYTES = 8 << 20       # characters of the counted pre-tokens a task remembers, 64 more for each; beyond that it starts anew
BLOCK_BYTES = 8 << 20       # text of a block; a longer document is a block of its own
AT_ONCE = 4096              # pre-tokens the library encodes in one call; an encoding takes many times the bytes of its text
SLICE_CODES = 1 << 20       # pre-tokens of a row of frequencies; a longer document is a row of its own
BLOCKS = "block long, part int, names binary, doc_ids array<long>, bytes array<long>, added array<long>, sizes array<int>, codes binary, times binary"
COUNTS = "block long, part int, counts binary"
COMMON = r"[^\x00-\x1b\x20-ԯ‐-‧‰-⁞₠-₵]"


class Pieces:
    """Splits texts into pre-tokens and counts their pieces for one tokenizer file; counts are kept up to ``KNOWN_BYTES``."""

    def __init__(self, path: str):
        # a task has one core; threads of the library's own would each keep memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.unusual = regex.compile(COMMON)
        self.known: dict[str, int] = {}
        self.held = 0

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Frequencies of the pre-tokens, and the number of added tokens in the text.

        The pattern splits text of common characters as the library does; any other text is split by the library, whose
        pre-tokens are written in its byte alphabet and kept apart by a leading tab."""
        parts, added = [text], 0
        if self.split and self.split.search(text):
            parts = self.split.split(text)
            added = len(parts) - 1
        found: Counter = Counter()
        for part in parts:
            if self.unusual.search(part):
                found.update("\t" + piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
            else:
                found.update(self.pattern.findall(part))
        return found, added

    def count(self, wanted) -> dict[str, int]:
        """Pieces of every wanted pre-token."""
        if self.held > KNOWN_BYTES:
            self.known, self.held = {}, 0
        new = [w for w in wanted if w not in self.known]
        self.held += sum(map(len, new)) + 64 * len(new)
        plain = [w for w in new if not (w[0] == "\t" and len(w) > 1)]
        for lo in range(0, len(plain), AT_ONCE):
            some = plain[lo:lo + AT_ONCE]
            self.known.update(zip(some, map(len, self.tokenizer.encode_batch(some, add_special_tokens=False))))
        for w in new:
            if w[0] == "\t" and len(w) > 1:
                mapped = all(not c.isspace() for c in w[1:])
                self.known[w] = len(self.tokenizer.model.tokenize(w[1:])) if mapped else len(
                    self.tokenizer.encode(w, add_special_tokens=False))
        return self.known


class Block:
    """Frequencies of the pre-tokens of some documents."""

    def __init__(self):
        self.number_of: dict[str, int] = defaultdict()
        self.number_of.default_factory = self.number_of.__len__
        self.docs: list[tuple] = []
        self.held = 0

    def add(self, doc_id, size: int, found: Counter, added: int) -> None:
        codes = np.fromiter(map(self.number_of.__getitem__, found), np.int64, len(found))
        self.docs.append((doc_id, size, added, codes, np.fromiter(found.values(), np.int64, len(found))))
        self.held += size

    def rows(self, number: int, parts: int):
        """One row for each part that has pre-tokens, and one for each run of documents, numbered downwards from -1."""
        names, first, code = numbering(list(self.number_of), np.concatenate([d[3] for d in self.docs]), parts)
        for p in np.flatnonzero(np.diff(first)).tolist():
            yield number, p, pack_texts(names[first[p]:first[p + 1]].tolist()), *[None] * 6
        lo = 0
        while lo < len(self.docs):
            hi, size = lo, 0
            while hi < len(self.docs) and (hi == lo or size + len(self.docs[hi][3]) <= SLICE_CODES):
                size += len(self.docs[hi][3])
                hi += 1
            ids, sizes, added, codes, times = zip(*self.docs[lo:hi])
            codes = [code[c] for c in codes]
            order = [np.argsort(c) for c in codes]  # steps between sorted numbers are small
            steps = np.concatenate([np.diff(c[o], prepend=0) for c, o in zip(codes, order)])
            yield (number, -1 - lo, None, list(ids), list(sizes), list(added), [len(c) for c in codes], pack(steps),
                   pack(np.concatenate([t[o] for t, o in zip(times, order)])))
            lo = hi


BLOCK_TYPES = {"block": pa.int64(), "part": pa.int32(), "names": pa.binary(), "doc_ids": pa.list_(pa.int64()), "bytes": pa.list_(pa.int64()),
               "added": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "codes": pa.binary(), "times": pa.binary()}


def _blocks(path: str, parts: int):
    def cut(batches):
        splitter, block, number = Pieces(path), Block(), TaskContext.get().partitionId() << 32

        def rows():
            for row in block.rows(number, parts):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES.values())], names=list(BLOCK_TYPES))

        for part, _, offsets in pieces(batches):
            for i, text, size in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), np.diff(offsets).tolist()):
                if block.docs and block.held + size > BLOCK_BYTES:
                    yield from rows()
                    block, number = Block(), number + 1
                block.add(i, size, *splitter.pre_tokens(text))
        if block.docs:
            yield from rows()
    return cut


def _count(path: str):
    """Pieces of the pre-tokens of each row, in their order."""
    def count(batches):
        tokenizer = Pieces(path)
        for batch in batches:
            for block, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                names = unpack_texts(packed)
                known = tokenizer.count(names)
                counts = pack(np.fromiter(map(known.__getitem__, names), np.int64, len(names)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["block", "part", "counts"])
    return count


def _sum(parts: int):
    """Frequencies times pieces. Rows come sorted by block, the counts of its pre-tokens before its documents."""
    def total(batches):
        current, found, ready = None, {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != current:
                    current, found, ready = row["block"], {}, None
                if row["counts"] is not None:
                    found[row["part"]] = unpack(row["counts"])
                    continue
                if ready is None:
                    ready = np.zeros(parts * max(map(len, found.values()), default=0), np.int64)
                    for p, counts in found.items():
                        ready[np.arange(len(counts)) * parts + p] = counts
                steps, times = unpack(row["codes"]).astype(np.int64), unpack(row["times"]).astype(np.int64)
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                place = np.cumsum(steps)  # steps begin anew in every document
                before = np.append(0, place)[ends - sizes]
                weight = np.append(0, np.cumsum(ready[place - np.repeat(before, sizes)] * times))
                tokens = weight[ends] - weight[ends - sizes] + np.array(row["added"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["bytes"], pa.int64()), pa.array(tokens)],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``, for a byte-level BPE tokenizer file.

    A null text counts as empty: 0 bytes, 0 tokens. Added tokens inside a text are one token each, as the library's
    default has it. Rows with equal or null ids stay apart; texts of any length are counted whole; an empty table gives an
    empty one. Sizes the hash ranges by one pass over the lengths and writes the blocks to the shared folder when called."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, int(2 * (size / 2 ** 20) ** 0.5))  # distinct pre-tokens grow by less than the text does
    tasks = int(min(20_000, max(8, 2 * size // BLOCK_BYTES)))
    blocks = staged(rows.mapInArrow(_blocks(path, parts), BLOCKS), "pre_token_blocks")
    counts = blocks.where("part >= 0").select("block", "part", "names").repartition(parts, "part").mapInArrow(_count(path), COUNTS)
    frequencies = blocks.where("part < 0").drop("names").withColumn("counts", F.lit(None).cast("binary"))
    both = frequencies.unionByName(counts, allowMissingColumns=True)
    summed = both.repartition(tasks, "block").sortWithinPartitions("block", F.desc("part")).mapInArrow(
        _sum(parts), "doc_id long, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


@query()
def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
