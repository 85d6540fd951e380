"""Encoding into the pieces of a SentencePiece model and back, by a relational lattice.

A text, with a space before it, falls into units: it is cut between two characters that
stand side by side in no piece, so no piece crosses a cut, and units are encoded by
themselves, each different one once. The few units of more than LONG characters, in
which nothing can be cut, are cut after every LONG characters.

1. each unit's substrings of up to the longest piece's length are exploded,
2. joined with the piece table, which gives the edges of its lattice,
3. grouped by unit, and folded into the cheapest path with aggregate().

The model at hand is of the BPE kind, whose scores are ranks and no log-probabilities.
A path costs PIECE for each piece and its rank: the fewest pieces, then the lowest
ranks, then the longest piece first seen from the end. Characters without a piece fall
back to their bytes.

Texts take their units' ids from the most frequent units, which are broadcast (FREQUENT
at most), and from a row of their own that holds the ids of all other units in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import text as X
from docflow.llm.common import small_batches, stash

PIECE, BYTE = 10**7, 10**8
SPACE = "▁"
#: Units broadcast as a dictionary; and the most characters of a unit.
FREQUENT, LONG = 1 << 19, 64
#: Units whose lattices one task folds, about 1 KB each.
PORTION = 30_000
#: Bytes of numbers of units that a task turns into ids together.
PORTIONED = 1 << 18
#: Units that are counted together in a task, some 60 bytes each.
TALLIED = 1 << 18
#: An edge is one number: its end (7 bits), its cost, MOST - its length, and its id, in so many bits. Ids from CHAR on are characters spelt by bytes.
COST_BITS, SIZE_BITS, ID_BITS = 29, 5, 22
TAIL = SIZE_BITS + ID_BITS
MOST, CHAR = (1 << SIZE_BITS) - 1, 1 << 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """rows: (id, piece with plain spaces, cost) of ordinary pieces; texts: the bytes that each id stands for; zero: the id of byte 0."""

    rows: list[tuple[int, str, int]]
    texts: list[bytes]
    zero: int

    @cached_property
    def longest(self) -> int:
        return max(len(p) for _, p, _ in self.rows)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether two bytes belong together: of two ASCII characters, when they stand side by side in a piece, and within a character. And sorted codes of all pairs of characters."""
        codes = np.unique(np.array([ord(a) << 21 | ord(b) for _, p, _ in self.rows for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        table = np.zeros((256, 256), dtype=bool)
        a, b = codes >> 21, codes & (CHAR - 1)
        plain = (a < 128) & (b < 128)
        table[a[plain], b[plain]] = True
        table[:, 128:192] = True
        return table.ravel(), codes


@cache
def vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows, out, zero = [], [], -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            zero = i if piece == "<0x00>" else zero
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            piece = piece.replace(SPACE, " ")
            rows.append((i, piece, PIECE + int(min(-model.get_score(i), 10**6))))
            out.append(piece.encode())
    if zero < 0:
        raise ValueError("the model has no byte pieces")
    found = Vocabulary(rows, out, zero)
    if found.longest > MOST or len(out) > CHAR:
        raise ValueError(f"pieces of more than {MOST} characters, or more than {CHAR} pieces")
    return found


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece and way (an edge without its end): a table of the vocabulary's fixed size."""
    return spark.createDataFrame([(piece, cost << TAIL | (MOST - len(piece)) << ID_BITS | i) for i, piece, cost in vocabulary(path).rows], "piece string, way long")


def character(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The numbers of the characters that start at places of UTF-8 bytes."""
    one, two, three, four = (data[np.minimum(at + i, len(data) - 1)].astype(np.int64) for i in range(4))
    two, three, four = two & 63, three & 63, four & 63
    wide = np.where(one < 0xF0, (one & 15) << 12 | two << 6 | three, (one & 7) << 18 | two << 12 | three << 6 | four)
    return np.where(one < 0x80, one, np.where(one < 0xE0, (one & 31) << 6 | two, wide))


def units(c: X.Chunk, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each unit of a chunk."""
    data, n = c.data, len(c.data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    table, codes = words.pairs
    begins = np.ones(n, dtype=bool)
    begins[1:] = ~table[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    wide = data >= 0x80
    if wide.any():  # pairs that aren't both ASCII
        at = np.flatnonzero(begins[1:] & (wide[1:] | wide[:-1])) + 1
        before = at - 1
        for _ in range(3):
            before -= (data[before] & 0xC0) == 0x80
        begins[at] = ~np.isin(character(data, before) << 21 | character(data, at), codes)
    begins[c.offsets[:-1][c.offsets[:-1] < n]] = True
    starts = np.flatnonzero(begins)
    if np.diff(np.append(starts, n)).max() > LONG:
        at = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(at, starts)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        starts = at[place % LONG == 0]
    return starts, np.append(starts[1:], n), np.searchsorted(c.offsets, starts, "right") - 1


def prefixed(text: Column) -> Column:
    """The text with a space before it; null and empty are empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text != "", F.concat(F.lit(" "), text)).otherwise("")


def _merged(parts: list[tuple[np.ndarray, pa.Array, np.ndarray]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    keys, first, which = np.unique(np.concatenate([k for k, _, _ in parts]), return_index=True, return_inverse=True)
    n = np.bincount(which, np.concatenate([n for _, _, n in parts]), len(keys)).astype(np.int64)
    return keys, pa.concat_arrays([u for _, u, _ in parts]).take(pa.array(first)), n


def distinct_units(docs: DataFrame, text: str, path: str) -> DataFrame:
    """key, unit, n: each different unit and how often it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, words = [], 0, vocabulary(path)
        for batch in batches:
            for c in X.chunks(batch.column(0)):
                starts, ends, _ = units(c, words)
                keys, first, n = np.unique(c.keys(starts, ends).view(np.int64), return_index=True, return_counts=True)
                bounds = pa.py_buffer(np.append(starts, len(c.data)).astype(np.int32))  # a unit ends where the next begins
                every = pa.Array.from_buffers(pa.string(), len(starts), [None, bounds, pa.py_buffer(c.data)])
                parts.append((keys, every.take(pa.array(first)), n))
                size += len(keys)
                if size > TALLIED:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size > TALLIED * 3 // 4:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, parts.pop())), ["key", "unit", "n"])
                        size = 0
        if size:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _merged(parts))), ["key", "unit", "n"])
        parts.clear()
        pa.default_memory_pool().release_unused()  # while the worker waits for its next task

    found = docs.select(prefixed(F.col(text)).alias("_text")).mapInArrow(work, "key long, unit string, n long")
    return found.groupBy("key").agg(F.min("unit").alias("unit"), F.sum("n").alias("n"))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND((1 << bits) - 1)


def _start(end: Column, way: Column) -> Column:
    return end - MOST + _low(F.shiftright(way, ID_BITS), SIZE_BITS).cast("int")


def folded(edges: Column, zero: int) -> Column:
    """The ids of the cheapest path through a unit's edges, sorted numbers, as array<int>.

    best has, for each position, the cost of the cheapest way to it with the size and id of its last
    edge, as one number; now is that of the last position so far. A smaller number is a
    smaller cost, or the same cost and a longer piece or a lower id. Then the path is
    followed back, as many steps as its cost allows for.
    """

    def reach(state: Column, e: Column) -> Column:
        end = F.shiftright(e, COST_BITS + TAIL).cast("int")
        before = F.coalesce(F.get(state["best"], _start(end, e)), state["now"])
        way = before.bitwiseAND(-1 << TAIL) + _low(e, COST_BITS + TAIL)
        further = F.struct(F.concat(state["best"], F.array(state["now"])).alias("best"), way.alias("now"))
        return F.when(F.size(state["best"]) < end, further).otherwise(F.struct(state["best"].alias("best"), F.least(state["now"], way).alias("now")))

    def back(s: Column, _: Column) -> Column:
        way = F.get(s["best"], s["at"])
        step = F.struct(s["best"].alias("best"), _start(s["at"], way).alias("at"), F.concat(F.array(_low(way, ID_BITS).cast("int")), s["ids"]).alias("ids"))
        return F.when(s["at"] > 0, step).otherwise(s)

    def spelt(s: Column) -> Column:
        each = F.transform(s["ids"], lambda i: F.when(i < CHAR, F.array(i)).otherwise(_byte_ids(i - CHAR, zero)))
        return F.when(F.array_max(s["ids"]) < CHAR, s["ids"]).otherwise(F.flatten(each))

    def path(s: Column) -> Column:
        most = F.floor(F.shiftright(s["now"], TAIL) / PIECE).cast("int")
        last = F.struct(F.concat(s["best"], F.array(s["now"])).alias("best"), F.size(s["best"]).alias("at"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(F.sequence(F.lit(1), most), last, back, spelt)

    first = F.struct(F.array().cast("array<long>").alias("best"), F.lit(0).cast("long").alias("now"))
    return F.aggregate(edges, first, reach, path)


def _byte_ids(code: Column, zero: int) -> Column:
    """The ids of the UTF-8 bytes of a character, given by its number."""
    more = lambda shift: F.shiftright(code, shift).bitwiseAND(63) + (128 + zero)
    lead = lambda shift, mark: F.shiftright(code, shift) + (mark + zero)
    return (
        F.when(code < 0x80, F.array(code + zero))
        .when(code < 0x800, F.array(lead(6, 0xC0), more(0)))
        .when(code < 0x10000, F.array(lead(12, 0xE0), more(6), more(0)))
        .otherwise(F.array(lead(18, 0xF0), more(12), more(6), more(0)))
    )


def encoded_units(found: DataFrame, path: str) -> DataFrame:
    """key, n and ids of each row of found(key, unit, n)."""
    words = vocabulary(path)
    portions = found.repartition(found.count() // PORTION + 1, "key")
    starts = portions.select("key", "unit", "n", F.explode(F.sequence(F.lit(1), F.length("unit"))).alias("start"))
    cuts = starts.select("key", "unit", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(words.longest), F.length("unit") - F.col("start") + 1))).alias("size"))
    cuts = cuts.select("key", "n", "start", "size", F.substring("unit", F.col("start"), F.col("size")).alias("piece"))
    # the piece table has the vocabulary's size; a character without a piece is an edge of its bytes
    edges = cuts.join(F.broadcast(piece_table(found.sparkSession, path)), "piece", "left").where(F.col("way").isNotNull() | (F.col("size") == 1))
    spelt = F.shiftleft((BYTE * F.octet_length("piece")).cast("long"), TAIL) + ((MOST - 1) << ID_BITS) + CHAR + F.ascii("piece")
    edge = F.shiftleft((F.col("start") + F.col("size") - 1).cast("long"), COST_BITS + TAIL) + F.coalesce("way", spelt)
    grouped = edges.select("key", "n", edge.alias("edge")).groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("edge")).alias("edges"))
    return grouped.select("key", "n", folded(F.col("edges"), words.zero).alias("ids"))


class Lists:
    """Lists of ids one after the other: where each begins and how long it is."""

    def __init__(self, lists: pa.ListArray):
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


class Dictionary(X.Index, Lists):
    """Ids by key; a key is known by its place among those given."""

    def __init__(self, keys: np.ndarray, lists: pa.ListArray):
        X.Index.__init__(self, keys)
        Lists.__init__(self, lists)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = super().find(keys)
        return np.where(at < 0, at, self.order[at]) if len(self.order) else at


def _ranked(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by row and key, and in it each key's place among the different keys of its row."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    other = np.ones(len(row), dtype=bool)
    other[1:] = row[1:] != row[:-1]
    new = other.copy()
    new[1:] |= keys[1:] != keys[:-1]
    count = np.cumsum(new)
    return order, count - np.maximum.accumulate(np.where(other, count, 0))


def numbers_as_bytes(x: np.ndarray, per_row: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers below 2^35, seven bits a byte, low ones first, the last byte of each below 128; and where each row's bytes start, and the last's end."""
    size = 1 + sum((x >> (7 * i) > 0).astype(np.int64) for i in range(1, 5))
    out = np.stack([(x >> (7 * i) & 127) | (size > i + 1) << 7 for i in range(5)], axis=1).astype(np.uint8)
    ends = np.append(0, np.cumsum(size))
    return out[np.arange(5) < size[:, None]].tobytes(), ends[np.append(0, np.cumsum(per_row))]


def numbers_of_bytes(data: np.ndarray) -> np.ndarray:
    """The numbers that numbers_as_bytes() wrote."""
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    out = np.zeros(len(ends), dtype=np.int64)
    for i in range(5):
        more = np.flatnonzero(starts + i <= ends)
        out[more] |= (data[starts[more] + i] & 127).astype(np.int64) << (7 * i)
    return out


def _frequent(known: DataFrame) -> tuple[Dictionary, int]:
    """The dictionary of the most frequent units, FREQUENT at most, the most frequent first, and the least count among them."""
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    total, least = 0, 1 << 62
    for r in known.groupBy(level).agg(F.count("*").alias("units"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():  # some hundred rows
        total += r.units
        if total > FREQUENT:
            break
        least = r.least
    top = known.where(F.col("n") >= least).select("key", "n", "ids").toArrow().sort_by([("n", "descending")]).combine_chunks()
    lists = top["ids"].combine_chunks() if len(top) else pa.array([], pa.list_(pa.int32()))
    return Dictionary(top["key"].to_numpy(), lists), least


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (key, _packed, _size, own) in portions of some PORTIONED bytes of numbers, whole rows each."""
    bounds, first = np.append(0, np.cumsum(batch.column(2).to_numpy())), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PORTIONED, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """key and ids of each row. Null and empty texts have no ids.

    The session's Arrow batches are set to BATCH rows if they are larger, as whole texts
    pass through them. Repeated rows, also of one key with different texts, are encoded
    each; an empty table gives an empty result; other columns are not read. Units are
    told apart by their 64-bit keys. A row's own units find it again by two 64-bit hashes of its key and
    text, so nothing depends on how the table is split when it is read anew.
    """
    path = model or default_model()
    small_batches(docs.sparkSession)
    known = stash(encoded_units(stash(distinct_units(docs, text, path), "units"), path), "dictionary")
    frequent, least = _frequent(known)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    whole = prefixed(F.col(text))
    rows = docs.select(F.col(key).alias("key"), whole.alias("_text"), F.xxhash64(F.col(key), whole).alias("one"), F.xxhash64(F.lit(1), whole, F.col(key)).alias("two"))
    kind = docs.schema[key].dataType.simpleString()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for c in X.chunks(batch.column(0)):
                starts, ends, row = units(c, words)
                keys = c.keys(starts, ends).view(np.int64)
                new = shared.value.find(keys) < 0
                keys, row = keys[new], row[new]
                once = ~X.repeated(keys.view(np.uint64), row)[1]
                at = pa.array(c.first + row[once])
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(keys[once])], ["one", "two", "unit"])

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hot, codec = vocabulary(path), shared.value, pa.Codec("zstd", compression_level=3)
        for batch in batches:
            packed, sizes = [], []
            for c in X.chunks(batch.column(1)):
                starts, ends, row = units(c, words)
                at = hot.find(keys := c.keys(starts, ends).view(np.int64))
                cold = np.flatnonzero(at < 0)
                order, place = _ranked(keys[cold], row[cold])
                at[cold[order]] = len(hot.keys) + place
                data, bounds = numbers_as_bytes(at, c.per_row(row))
                packed += [codec.compress(data[a:b], asbytes=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                sizes += np.diff(bounds).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64()), batch.column(2), batch.column(3)], ["key", "_packed", "_size", "one", "two"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, codec = shared.value, pa.Codec("zstd")
        for batch in (part for whole in batches for part in _portions(whole)):
            sizes = batch.column(2).to_numpy()
            data = np.frombuffer(b"".join(codec.decompress(t, decompressed_size=n, asbytes=True) if n else b"" for t, n in zip(batch.column(1).to_pylist(), sizes.tolist(), strict=True)), dtype=np.uint8)
            at, seen = numbers_of_bytes(data), np.append(0, np.cumsum(data < 128))
            stops = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), seen[stops] - seen[stops - sizes])
            # a row's rare units, in the order of their keys
            owned = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            own = batch.column(3).flatten()
            order, _ = _ranked(own.field(0).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(owned)), owned))
            cold = Lists(own.field(1))
            hit = at < len(hot.keys)
            rare, of = at[~hit] - len(hot.keys), row[~hit]
            most = np.zeros(len(owned), dtype=np.int64)
            np.maximum.at(most, of, rare + 1)
            if (most != owned).any():
                raise ValueError("a unit without ids: the table has changed while it was read")
            at[~hit] = order[(np.cumsum(owned) - owned)[of] + rare]
            begin, n = np.empty_like(at), np.empty_like(at)
            for which, d in ((hit, hot), (~hit, cold)):
                begin[which], n[which] = d.begin[at[which]], d.size[at[which]]
            stop = np.cumsum(n)
            source = np.repeat(begin - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
            from_hot = np.repeat(hit, n)
            flat = np.empty(len(source), dtype=np.int32)
            flat[from_hot], flat[~from_hot] = hot.ids[source[from_hot]], cold.ids[source[~from_hot]]
            bounds = np.append(0, np.cumsum(np.bincount(row, n, len(sizes)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["key", "ids"])

    rare = known.where(F.col("n") < least).select(F.col("key").alias("unit"), "ids")
    tails = rows.select("_text", "one", "two").mapInArrow(others, "one long, two long, unit long").join(rare, "unit")
    tails = tails.groupBy("one", "two").agg(F.collect_set(F.struct("unit", "ids")).alias("own"))
    small = rows.mapInArrow(squeezed, f"key {kind}, _packed binary, _size long, one long, two long")  # texts are the most that is shuffled, as numbers of units: frequent ones by their rank, then the row's own
    both = small.join(tails, ["one", "two"], "left").select("key", "_packed", "_size", F.coalesce("own", F.array().cast("array<struct<unit:bigint,ids:array<int>>>")).alias("own"))
    return both.mapInArrow(assembled, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(coded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """coded with text: what its ids stand for, without the space that encoding put before it. Null ids give null."""
    path = model or default_model()
    names = coded.columns
    at = names.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path).texts
        sizes = np.array([len(b) for b in table], dtype=np.int64)
        bounds, raw = np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(table), dtype=np.uint8)
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            own = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            n = sizes[flat]
            stop = np.append(0, np.cumsum(n))
            data = raw[np.repeat(bounds[flat] - stop[:-1], n) + np.arange(stop[-1])]
            ends = stop[own]
            heads = ends[:-1] + (ends[1:] > ends[:-1])
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(heads.tolist(), ends[1:].tolist(), strict=True)]
            made = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(work, f"{fields}, text string")
