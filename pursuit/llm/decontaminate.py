"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders, so a question asked again with other values has the same
template. Windows of the template are hashed and joined with the windows of the benchmark's items; matches that lie on one
alignment of a document with an item count together, and the values behind the placeholders must map one to one between
the two, which a re-parameterised question does and a chance match of templates does not.

Whether a word is a name depends on where it stands, so windows are matched in several ways, and one is enough: by the
template of either side; by the words and values alone, whatever their case; and by the places where the item has names
or may have them, with any word of the document there. Words alone are matched at any density of values and any length of
the item.
"""

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pursuit.llm.names import unused
from pursuit.llm.registry import query, table
from pursuit.llm.words import mix, pieces, run_hashes, word_hashes
from pursuit.staging import lookup, staged

WINDOW = 8              # template tokens in a window
SHORTEST = 4            # items of fewer tokens have no template and must stand word by word; below WINDOW an item is one window
LITERALS = 0.5          # share of a window that must be plain words, unless all its tokens are compared
ENOUGH = 6              # matching windows on one alignment, or all that the item has
TEMPLATE, WORDS, NAMES, OPENINGS = range(4)   # ways to match; OPENINGS takes capitals that begin a sentence as names too
FILTER_BITS = 22        # bitmaps of this fixed size tell which windows may be an item's
TEXT_PIECE = 1 << 20    # bytes of documents that are worked on at once
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs hour hours day days week weeks month months year "
         "years second seconds minute minutes meter meters metre metres kilometer kilometers mile miles gram grams kilogram "
         "kilograms liter liters litre litres pound pounds euro euros dollar dollars cent cents percent degree degrees kmh mph "
         "kb mb gb tb hz khz mhz ghz v w kw j kj cal kcal").split()
LITERAL, NUMBER, NAME, UNIT = range(4)

CLASS = np.zeros(256, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASS[48:58] = 2


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) + 1 for u in UNITS]) - 1
    return word_hashes(data, ends - np.array([len(u) for u in UNITS]), ends)


def _lowered() -> np.ndarray:
    """By code point, the lower case as two or three bytes of UTF-8 where it has as many as the character itself; ß as ss
    and the last sigma as any, as their capitals have it."""
    out = np.arange(1 << 16)
    for c in range(128, 1 << 16):
        if not 0xD800 <= c < 0xE000:
            low = {"ß": "ss", "ς": "σ"}.get(chr(c), chr(c).lower()).encode()
            same = low if len(low) == (2 if c < 0x800 else 3) else chr(c).encode()
            out[c] = int.from_bytes(same, "big")
    return out


def _classes() -> np.ndarray:
    """By code point: 0 punctuation and spaces, 1 letters and signs, 2 characters of scripts without spaces between words."""
    out = np.ones(1 << 16, np.uint8)
    for a, z in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31BF),
                 (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
        out[a:z + 1] = 2
    out[[c for c in range(1 << 16) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cc", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po")]] = 0
    return out


UNIT_HASHES = _unit_hashes()
CLASSES = _classes()
LOWERED = _lowered()
PLACE = mix(np.arange(1, WINDOW + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def characters(data: np.ndarray):
    """``(first byte, size, code point)`` of the characters of two and three bytes."""
    two = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0))
    three = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF0))
    byte = lambda at, i: (data[at + i] & 63).astype(np.int64)
    code = np.concatenate([(data[two] & 31).astype(np.int64) << 6 | byte(two, 1),
                           (data[three] & 15).astype(np.int64) << 12 | byte(three, 1) << 6 | byte(three, 2)])
    return np.concatenate([two, three]), np.repeat([2, 3], [len(two), len(three)]), code


def lower(data: np.ndarray, at: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The bytes with their characters lowered, at the same places. A-Z stay; the hash of a word does not see their case."""
    low, out = LOWERED[code], data.copy()
    for i in range(3):
        has = size > i
        out[at[has] + i] = (low[has] >> (8 * (size[has] - 1 - i))) & 255
    return out


def template(data: np.ndarray, offsets: np.ndarray):
    """``(doc, kind, code, value, opening)`` of every token: a run of letters, a number, or a character
    of a script without spaces. ``value`` is the hash of the lowered
    token, ``code`` the same for plain words and one constant for each kind of placeholder. A number may hold points and
    commas; a unit follows a number; a name has a capital and does not begin a sentence; ``opening`` is a word with a capital
    that does."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, bool)
    at, size, code = characters(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    cls = CLASS[data].copy()
    inner = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
    inner = inner[(cls[inner - 1] == 2) & (cls[inner + 1] == 2) & ~edge[inner] & ~edge[inner + 1]]
    cls[inner] = 2
    group = CLASSES[code]
    for i in range(3):
        cls[at[(group == 0) & (size > i)] + i] = 0
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (cls[1:] != cls[:-1]) | edge[1:-1]
    alone = group == 2
    far = np.flatnonzero((data[:-1] == 0xF0) & (data[1:] >= 0xA0) & (data[1:] < 0xC0))     # Han beyond 16 bits
    for first, last in ((at[alone], at[alone] + size[alone]), (far, far + 4)):
        change[first] = change[last] = True
    start = np.flatnonzero((cls > 0) & change[:-1])
    end = np.flatnonzero((cls > 0) & change[1:]) + 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), *(np.zeros(0, np.uint64),) * 2, np.zeros(0, bool)
    doc = np.searchsorted(offsets, start, "right") - 1
    value = word_hashes(np.where(cls > 0, lower(data, at, size, code), np.uint8(32)), start, end)

    stops = np.append(0, np.cumsum(np.isin(data, np.frombuffer(b".!?:;\n", np.uint8)) & (cls == 0)))
    before = np.append(0, end[:-1])
    opens = (stops[start] > stops[before]) | np.diff(doc, prepend=-1).astype(bool)
    lead, second = data[start], data[np.minimum(start + 1, len(data) - 1)]
    capital = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    number = cls[start] == 2
    follows = np.append(False, number[:-1]) & ~np.diff(doc, prepend=-1).astype(bool)
    kind = np.select([number, follows & np.isin(value, UNIT_HASHES), capital & ~opens], [NUMBER, UNIT, NAME], LITERAL).astype(np.uint8)
    code = np.where(kind == LITERAL, value, mix(kind.astype(np.uint64) + np.uint64(1 << 32)))
    return doc, kind, code, value, (kind == LITERAL) & capital & opens


def windows(doc, kind, code, size: int):
    """``(hash, doc, first token)`` of the windows of one size that hold enough plain words."""
    if len(code) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:len(doc) - size + 1] == doc[size - 1:])
    hashes, owner = run_hashes(code, doc, size, short=False)
    plain = np.append(0, np.cumsum(kind == LITERAL))
    keep = plain[at + size] - plain[at] >= LITERALS * size
    return mix(hashes[keep] + np.uint64(size)), owner[keep], at[keep]


def masked(code: np.ndarray, at: np.ndarray, size: int, mask: int) -> np.ndarray:
    """Hashes of the windows that begin at ``at`` without the places whose bits are in ``mask``. They are not mixed yet: equal
    windows have equal hashes for one mask and size only."""
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        if not mask >> j & 1:
            out += code[at + j] * PLACE[j]
    return out


def whole(doc: np.ndarray, size: int) -> np.ndarray:
    """The first tokens of the windows of one size."""
    return np.flatnonzero(doc[:len(doc) - size + 1] == doc[size - 1:]) if len(doc) >= size else np.zeros(0, np.int64)


def anchor_of(size: int, mask: int) -> tuple[int, ...]:
    """The first three places of a window that are not masked, or as many as there are."""
    return tuple([j for j in range(size) if not mask >> j & 1][:3])


def anchors(code: np.ndarray, at: np.ndarray, gaps) -> np.ndarray:
    """Hashes of up to three tokens, the others ``gaps`` after the first, by which windows with placeholders are looked up
    first: there are far fewer distances between three tokens than masks."""
    out = np.full(len(at), mix(np.array([sum(g << 4 * i for i, g in enumerate(gaps)) + (1 << 41)], np.uint64))[0])
    for i, g in enumerate(gaps):
        out += code[at + g] * PLACE[i]
    return out * PLACE[3]


def tagged(hashes: np.ndarray, way: int, size: int, mask: int) -> np.ndarray:
    """Hashes of ``masked``, told apart by size and mask, and of the words alone from those with placeholders."""
    tag = np.array([(way == WORDS) << 20 | size << 10 | mask], np.uint64)
    return (hashes ^ mix(tag + np.uint64(1 << 40))) * PLACE[0]


FOUND = "id long, fa long, hash long, pos long, slots array<long>, way int, size int, mask int, anchor long"
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int64())


def _found(out: list):
    columns = list(zip(*out)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)],
                                      names=["id", "fa", "hash", "pos", "slots", "way", "size", "mask", "anchor"])


def _places(hashes) -> tuple:
    """The two bits of a hash in a bitmap."""
    return hashes >> np.uint64(64 - FILTER_BITS), (hashes >> np.uint64(64 - 2 * FILTER_BITS)) & np.uint64((1 << FILTER_BITS) - 1)


def _bitmap(rows: DataFrame, column: str) -> bytes:
    low = F.shiftrightunsigned(column, 64 - 2 * FILTER_BITS).bitwiseAND((1 << FILTER_BITS) - 1)
    both = rows.where(F.col(column).isNotNull()).select(F.explode(F.array(F.shiftrightunsigned(column, 64 - FILTER_BITS), low)).alias("bit"))
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    bits[np.array([r[0] for r in both.distinct().collect()], np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _admitted(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a bitmap."""
    first, second = _places(hashes)
    at = np.flatnonzero(bits[first.astype(np.int64)])
    return at[bits[second[at].astype(np.int64)]]


def _item_windows(batches):
    """Rows of the windows of every item by all ways: one window size each, by the item's own length. Slots are the values
    of what the way takes for placeholders; for WORDS of what the template has."""
    for rows, data, offsets in pieces(batches):
        doc, kind, code, value, opening = template(data, offsets)
        typed = np.where((kind == NUMBER) | (kind == UNIT), code, value)
        begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
        count = np.bincount(doc, minlength=len(offsets) - 1)
        ids, fas = rows.column("id").to_pylist(), rows.column("fa").to_pylist()
        out = []

        def add(hashes, at, way, size, mask, free, anchor=None):
            anchor = [None] * len(at) if anchor is None else anchor.view(np.int64).tolist()
            for h, a, x in zip(hashes.view(np.int64).tolist(), at.tolist(), anchor):
                d = doc[a]
                out.append((ids[d], fas[d], h, a - int(begin[d]), value[a:a + size][free[a:a + size]].view(np.int64).tolist(), way, size, mask, x))

        for size in range(1, WINDOW + 1):
            mine = lambda at: np.minimum(count[doc[at]], WINDOW) == size  # noqa: E731, B023
            at = whole(doc, size)
            at = at[mine(at)]
            add(tagged(masked(value, at, size, 0), WORDS, size, 0), at, WORDS, size, 0, kind != LITERAL)
            if size < SHORTEST:
                continue
            hashes, _, first = windows(doc, kind, code, size)
            add(hashes[mine(first)], first[mine(first)], TEMPLATE, size, 0, kind != LITERAL)
            for way, name in ((NAMES, kind == NAME), (OPENINGS, (kind == NAME) | opening)):
                free = name | (kind == NUMBER) | (kind == UNIT)
                full = np.append(0, np.cumsum(~free))
                places = sum(name[at + j].astype(np.int64) << j for j in range(size)) if len(at) else at
                admitted = full[at + size] - full[at] >= LITERALS * size
                for mask in np.unique(places[admitted]).tolist():
                    has = at[admitted & (places == mask)]
                    first, *more = anchor_of(size, mask)
                    anchor = anchors(typed, has + first, [0, *(j - first for j in more)])
                    add(tagged(masked(typed, has, size, mask), way, size, mask), has, way, size, mask, free, anchor)
        yield _found(out)


def _windows_of(shapes, bitmap: bytes, anchored: bytes):
    """Rows of the windows of every text that the bitmaps admit, in the ``shapes`` (way, size, mask) that items have. Windows
    of NAMES and OPENINGS are the same here and stand under NAMES. WORDS have no slots: they are the item's."""
    by_gaps: dict[tuple, set] = {}
    for way, size, mask in shapes:
        if way >= NAMES:
            first, *more = anchor_of(size, mask)
            by_gaps.setdefault((0, *(j - first for j in more)), set()).add((size, mask, first))
    plain = sorted({(way, size) for way, size, _ in shapes if way < NAMES})

    def run(batches):
        bits, anchor_bits = (np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").view(bool) for b in (bitmap, anchored))
        for rows, data, offsets in pieces(batches, limit=TEXT_PIECE):
            doc, kind, code, value, _ = template(data, offsets)
            counted = (kind == NUMBER) | (kind == UNIT)
            typed = np.where(counted, code, value)
            begin = np.searchsorted(doc, np.arange(len(offsets) - 1))
            ids, fas = rows.column("id").to_pylist(), rows.column("fa").to_pylist()
            out = []

            def add(hashes, at, way, size, mask):
                keep = _admitted(hashes, bits)
                hashes, at = hashes[keep], at[keep]
                if way == WORDS and size < WINDOW:      # a whole item: once in a text is enough
                    _, once = np.unique(np.stack([doc[at], hashes.view(np.int64)]), axis=1, return_index=True)
                    hashes, at = hashes[once], at[once]
                places = np.array([mask >> j & 1 for j in range(size)], bool)
                for h, a in zip(hashes.view(np.int64).tolist(), at.tolist()):
                    d = doc[a]
                    slots = None
                    if way != WORDS:
                        free = kind[a:a + size] != LITERAL if way == TEMPLATE else counted[a:a + size] | places
                        slots = value[a:a + size][free].view(np.int64).tolist()
                    out.append((ids[d], fas[d], h, a - int(begin[d]), slots, way, size, mask, None))

            for way, size in plain:
                if way == TEMPLATE:
                    hashes, _, at = windows(doc, kind, code, size)
                    add(hashes, at, way, size, 0)
                else:
                    at = whole(doc, size)
                    add(tagged(masked(value, at, size, 0), way, size, 0), at, way, size, 0)
            for gaps, those in sorted(by_gaps.items()):
                at = whole(doc, gaps[-1] + 1)
                at = at[_admitted(anchors(typed, at, gaps), anchor_bits)]
                for size, mask, first in sorted(those):
                    has = at[(at >= first) & (at - first + size <= len(doc))] - first
                    has = has[doc[has] == doc[has + size - 1]]
                    add(tagged(masked(typed, has, size, mask), NAMES, size, mask), has, NAMES, size, mask)
            yield _found(out)
    return run


def _texts(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("fa"), text.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, fa, item_id, n_windows, item_windows, n_slots, n_changed`` for every document and item it contains.

    A pair counts if in one of the ways to match and on one alignment at least ENOUGH windows match, or all the item has,
    and the values of the placeholders map one to one. The figures are those of the way with most windows. ``n_changed`` of
    ``n_slots`` distinct values differ from the item's. Null texts and those without a letter or digit match nothing; rows of one id are told apart by
    ``fa``, a hash of the text; repeated rows give one pair; null ids are kept. Reads the benchmark's windows when called."""
    items = staged(_texts(benchmark, "item_id").distinct().mapInArrow(_item_windows, FOUND), "items")
    shapes = [tuple(r) for r in items.select("way", "size", "mask").distinct().collect()]
    lengths = items.groupBy(F.col("id").alias("item_id"), F.col("fa").alias("item_fa"), F.col("way").alias("item_way")).agg(
        F.count("*").alias("item_windows"))
    own = items.select(F.col("id").alias("_id"), F.col("fa").alias("_fa"), F.col("way").alias("_way"), "hash", F.least("way", F.lit(NAMES)).alias("way"),
                       "size", "mask", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    own = lookup(own.join(lengths, F.col("_id").eqNullSafe(F.col("item_id")) & (F.col("_fa") == F.col("item_fa"))
                          & (F.col("_way") == F.col("item_way"))).drop("_id", "_fa", "_way"), "item_windows")

    found = _texts(docs, "doc_id").mapInArrow(
        _windows_of(shapes, _bitmap(items, "hash"), _bitmap(items, "anchor")), FOUND).drop("anchor")
    matched = found.join(own, ["hash", "way", "size", "mask"]).withColumn("alignment", F.col("pos") - F.col("item_pos"))
    pairs = F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("item"), F.coalesce("slots", "item_slots").alias("doc"))))
    aligned = matched.groupBy("id", "fa", "item_id", "item_fa", "item_way", "alignment", "item_windows").agg(
        F.count_distinct("item_pos").alias("n_windows"), F.array_distinct(pairs).alias("values"))
    values = lambda side: F.size(F.array_distinct(F.transform("values", lambda v: v[side])))
    changed = F.size(F.filter("values", lambda v: v["item"] != v["doc"]))
    kept = aligned.where((F.col("n_windows") >= F.least(F.lit(ENOUGH), F.col("item_windows")))
                         & (values("item") == F.size("values")) & (values("doc") == F.size("values")))
    return kept.select("id", "fa", "item_id", "item_windows", "n_windows", F.size("values").alias("n_slots"), changed.alias("n_changed")) \
        .groupBy(F.col("id").alias("doc_id"), "fa", "item_id").agg(
            F.max(F.struct("n_windows", "item_windows", "n_slots", "n_changed")).alias("best")) \
        .select("doc_id", "fa", "item_id", "best.*")


@query()
def op4_decontaminate(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("fa")


def without_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain no benchmark item."""
    ident, fa, key = unused(docs, "_id", "_fa", "_key")
    bad = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(ident), F.col("fa").alias(fa)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(key) == F.col(fa)), "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
