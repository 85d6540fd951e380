"""Repair of the structure of conversations at the least cost, by a grammar-compressed dynamic program.

A row becomes one symbol of nine: its role's initial and whether it is truncated, or that it must go.
A conversation is cut into segments of SEGMENT symbols, and each different segment is worked out once for
all conversations that have it:

1. Re-Pair over the segments: Spark counts adjacent pairs of symbols, the most frequent ones become new
   symbols, and so on until no pair comes twice or there are RULES rules.
2. A transfer matrix has, for each state of the target form before and after a symbol, the least cost and
   the audit of the edits that lead there. Matrices multiply by (min, +), ties to the ASCII-least
   audit. Each rule's matrix is the product of its two symbols', made once and from the bottom up; its audits are ropes over
   theirs. A segment's is the product of its symbols' matrices, a conversation's that of its segments', SEGMENTS at a time.

This is exact: costs follow from the audit, so of two audits of one cost and one stretch of rows neither begins with the
other, and the order of audits doesn't change when something is put before or after both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import drop_stash, met, ranked, small_batches, stash

SEGMENT, SEGMENTS = 256, 16
#: Rules of the grammar at most (so much is broadcast), and how many a count of pairs gives at most.
RULES, ROUND = 128, 16
#: States of the target form (s?(ua)+)?: nothing yet, after s, after u, after a. It may end in the first and the last.
STATES, ENDS = 4, (0, 3)
AFTER_USER, AFTER_ASSISTANT = (0, 1, 3), (2,)
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 1, 2, 5, 5
BLANK = r"^[\x20\x09-\x0D]*\z"


@dataclass(slots=True)
class Way:
    """What leads from one state to another: a cost and an audit, a rope over the audits of shared parts."""

    cost: int
    parts: tuple[Way, ...] = ()
    flat: str | None = field(default=None)

    @property
    def audit(self) -> str:
        if self.flat is None:
            self.flat = "".join(p.audit for p in self.parts)
        return self.flat


Matrix = list[Way | None]


def _better(a: Way | None, b: Way) -> Way:
    return b if a is None or b.cost < a.cost or (b.cost == a.cost and b.audit < a.audit) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    """One stretch after the other: the best way by any state between them."""
    out: Matrix = [None] * STATES**2
    for i in range(STATES):
        for k in range(STATES):
            if (x := a[i * STATES + k]) is not None:
                for j in range(STATES):
                    if (y := b[k * STATES + j]) is not None:
                        at, cost = i * STATES + j, x.cost + y.cost
                        if out[at] is None or cost <= out[at].cost:
                            out[at] = _better(out[at], Way(cost, (x, y)))
    return out


def _matrix(steps: list[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [None] * STATES**2
    for i, j, cost, audit in steps:
        out[i * STATES + j] = _better(out[i * STATES + j], Way(cost, (), audit))
    return out


def _emits(who: str) -> list[tuple[int, int]]:
    return {"s": [(0, 1)], "u": [(i, 2) for i in AFTER_USER], "a": [(i, 3) for i in AFTER_ASSISTANT]}.get(who, [])


_stay = [(i, i, 0, "") for i in range(STATES)]
_once = _matrix(_stay + [(i, j, INSERT, "I") for who in "ua" for i, j in _emits(who)])
INSERTS = product(_once, product(_once, _once))


def terminal(symbol: str) -> Matrix:
    """Inserts, then what may be done to one row. symbol: s, u, a, o(ther), capitals where truncated; x must be deleted."""
    more = UNMENDED if symbol.isupper() else 0
    steps = [(i, i, DELETE, "D") for i in range(STATES)]
    if symbol != "x":
        steps += [(i, j, KEEP + more, "K") for i, j in _emits(symbol.lower())]
        steps += [(i, j, REROLE + more, "R") for who in "ua" for i, j in _emits(who)]
    return product(INSERTS, _matrix(steps))


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """The matrix of each symbol; rules (pair, symbol) come after those that they use."""
    out = {c: terminal(c) for c in "suaoSUAOx"}
    for pair, symbol in rules:
        out[symbol] = product(out[pair[0]], out[pair[1]])
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted damage, by crc32("conv_id:turn") modulo 20; a null is one space there, and in role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    found = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), dealt.alias("_dealt")).where("_dealt <> 0")
    text = F.when(F.col("_dealt") == 1, F.lit("")).when(F.col("_dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_dealt") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_dealt") == 3, 2).otherwise(1)))
    return found.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn, role, text, fault (blank, duplicate, truncated or null) and symbol; rows: ranked, with pos."""
    blank = F.col("text").rlike(BLANK)
    first = rows.where(~blank).groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("pos").alias("_pos"))
    first = first.select(F.col("conv_id").alias("_conv"), "_pos")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    slim = rows.select("conv_id", "pos", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("_blank"), last.isin(".", "!", "?").alias("_ended"))
    found = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_pos").isNull(), "duplicate").when(~F.col("_ended"), "truncated")
    who = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(who)).otherwise(who)
    return found.select("conv_id", "pos", "turn", "initial", fault.alias("fault")).withColumn("symbol", symbol)


def grammar(texts: DataFrame, rules: int = RULES) -> list[tuple[str, str]]:
    """Re-Pair rules (pair, new symbol) over the column seq of texts, the ROUND most frequent pairs of each count. Rules replace from left to right, in their order."""
    found: list[tuple[str, str]] = []
    while len(found) < rules:
        seq = rewritten(F.col("seq"), found)
        pairs = F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda i: F.substr(seq, i, F.lit(2)))  # noqa: B023
        counted = texts.where(F.length(seq) > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
        top = counted.where("n > 1").orderBy(F.desc("n"), "pair").limit(min(ROUND, rules - len(found))).collect()
        if not top:
            break
        found += [(row.pair, chr(0xE000 + len(found) + k)) for k, row in enumerate(top)]
    return found


def rewritten(seq: Column, rules: list[tuple[str, str]]) -> Column:
    for pair, symbol in rules:
        seq = F.replace(seq, F.lit(pair), F.lit(symbol))
    return seq


COSTS, AUDITS = pa.list_(pa.int64()), pa.list_(pa.string())


def _flat(ways: list[Matrix]) -> list[pa.Array]:
    return [pa.array([[w and w.cost for w in m] for m in ways], COSTS), pa.array([[w and w.audit for w in m] for m in ways], AUDITS)]


def transfers(texts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """texts(seq, n) with costs and audits, a matrix by rows, null where no way leads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrices(rules)
        for batch in batches:
            ways = [reduce(product, (known[c] for c in seq)) for seq in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_flat(ways)], ["seq", "n", "costs", "audits"])

    return texts.select("seq", "n", rewritten(F.col("seq"), rules).alias("_short")).mapInArrow(work, "seq string, n long, costs array<long>, audits array<string>")


def _joined(parts: DataFrame) -> DataFrame:
    """SEGMENTS neighbouring matrices of a conversation as one."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        all_ = [[None if c is None else Way(c, (), a) for c, a in zip(costs, audits, strict=True)] for costs, audits in zip(table["costs"].to_pylist(), table["audits"].to_pylist(), strict=True)]
        return pa.table([table["conv_id"].slice(0, 1).combine_chunks(), pa.array([table["up"][0].as_py()], pa.int64()), *_flat([reduce(product, all_)])], ["conv_id", "seg", "costs", "audits"])

    kind = parts.schema["conv_id"].dataType.simpleString()
    up = parts.withColumn("up", F.floor(F.col("seg") / SEGMENTS).cast("long"))
    return up.groupBy("conv_id", "up").applyInArrow(work, f"conv_id {kind}, seg long, costs array<long>, audits array<string>")


def plans(marked: DataFrame) -> DataFrame:
    """conv_id, cost, audit and illegal of each conversation that has rows; marked: from faults(), written."""
    seg, start = F.floor(F.col("pos") / SEGMENT).cast("long"), F.col("pos") % SEGMENT == 0
    into = F.explode(F.when(start & (F.col("pos") > 0), F.array(seg, seg - 1)).otherwise(F.array(seg)))  # the first row is also seen from the segment before
    spread = marked.select("conv_id", into.alias("seg"), "pos", "symbol", "initial").withColumn("own", F.floor(F.col("pos") / SEGMENT) == F.col("seg"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "symbol", "initial", "own")))
    grouped = spread.groupBy("conv_id", "seg").agg(rows.alias("rows"))
    seq = F.array_join(F.transform(F.filter("rows", lambda r: r["own"]), lambda r: r["symbol"]), "")
    pair = lambda i: F.concat(F.get("rows", i - 1)["initial"], F.get("rows", i)["initial"])
    wrong = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i > 0) & ~pair(i).isin("su", "ua", "au"))
    segments = stash(grouped.select("conv_id", "seg", seq.alias("seq"), F.size(wrong).cast("long").alias("illegal")), "segments")
    texts = stash(segments.groupBy("seq").agg(F.count("*").alias("n")), "texts")
    found = stash(transfers(texts, grammar(texts)), "transfers")
    parts = met(segments, found, "seq", ["costs", "audits"])
    alone = (F.col("seg") == 0) & (F.length("seq") < SEGMENT)
    whole = parts.where(alone).select("conv_id", "costs", "audits")
    rest = stash(parts.where(~alone).select("conv_id", "seg", "costs", "audits"), "parts")
    while not rest.isEmpty():
        level = stash(_joined(rest), "parts")
        drop_stash(rest)
        if level.where("seg > 0").isEmpty():
            whole = whole.unionByName(level.select("conv_id", "costs", "audits"))
            break
        rest = level
    # the way to an end, from nothing: through each state, with what is inserted last
    ways = [F.struct((F.get("costs", F.lit(i)) + w.cost).alias("cost"), F.concat(F.get("audits", F.lit(i)), F.lit(w.audit)).alias("audit")) for i in range(STATES) for j in ENDS if (w := INSERTS[i * STATES + j]) is not None]
    best = F.array_min(F.filter(F.array(*ways), lambda w: w["cost"].isNotNull()))
    illegal = segments.groupBy(F.col("conv_id").alias("_conv")).agg(F.sum("illegal").alias("illegal"))
    return whole.select("conv_id", best.alias("best")).join(illegal, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "best.cost", "best.audit", "illegal")


class Walk:
    """Applies an audit to a conversation's rows as they come, in order; keeps no row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        user = self.state in AFTER_USER
        self.state = 2 if user else 3
        return "user" if user else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands before the row and in its place."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._next(), text
        elif edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
            yield edit, role, text


def _walked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of a conversation after its audit, in one partition and in order, for a task to stream."""
    heads = plan.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = heads.unionByName(rows.select("conv_id", "pos", "role", "text", F.lit(None).cast("string").alias("audit")))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, None) where a conversation begins, then (conv_id, (edit, role, text)) for each repaired row."""
    walk, conv = None, None
    for batch in batches:
        for key, pos, role, text, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pos < 0:
                if walk:
                    yield from ((conv, e) for e in walk.inserted())
                walk, conv = Walk(audit), key
                yield conv, None
            else:
                yield from ((conv, e) for e in walk.row(role, text))
    if walk:
        yield from ((conv, e) for e in walk.inserted())


def _streamed(fields: str, rows: Iterator[tuple], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """rows as batches; the first field has the type of the incoming batches' first column."""
    names, out = fields.split(), []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[0] if i == 0 else None) for i, c in enumerate(columns)], names)

    for row in rows:
        out.append(row)
        if len(out) >= 1_000:
            yield batch()
            out.clear()
    if out:
        yield batch()


def _typed(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds.append(batch.schema.field(0).type)
        yield batch


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text of the repaired conversations; place orders them from 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            place = 0
            for conv, event in _events(_typed(batches, kinds)):
                if event is None:
                    place = 0
                else:
                    yield (conv, place, *event)
                    place += 1

        kinds: list[pa.DataType] = []
        yield from _streamed("conv_id place edit role text", made(), kinds)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _walked(rows, plan).mapInArrow(work, f"conv_id {kind}, place long, edit string, role string, text string")


def _digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, the digest of the repaired rows as role:text, joined by line feeds. Texts are hashed as they pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            digest, last, empty = None, None, True
            for conv, event in _events(_typed(batches, kinds)):
                if event is None:
                    if digest:
                        yield last, digest.hexdigest()
                    digest, last, empty = hashlib.sha256(), conv, True
                else:
                    digest.update(f"{'' if empty else chr(10)}{event[1]}:{event[2]}".encode())
                    empty = False
            if digest:
                yield last, digest.hexdigest()

        kinds: list[pa.DataType] = []
        yield from _streamed("conv_id repaired_sha256", made(), kinds)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _walked(rows, plan).mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


@dataclass
class Repair:
    """Written rows in order (pos), their faults, and a plan for each conversation that has rows."""

    rows: DataFrame
    marked: DataFrame
    plan: DataFrame

    def counts(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated of each conversation that has rows."""
        is_ = lambda f: F.coalesce(F.col("fault") == f, F.lit(False)).cast("long")
        kinds = ["blank", "duplicate", "truncated"]
        turns = self.marked.groupBy("conv_id", "turn").agg(*(F.sum(is_(k)).alias(k) for k in kinds))
        gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
        return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *(F.sum(k).alias(k) for k in kinds))

    def repaired(self) -> DataFrame:
        return repaired(self.rows, self.plan)

    def digests(self) -> DataFrame:
        return _digests(self.rows, self.plan)


def repair(rows: DataFrame) -> Repair:
    """The cheapest repair of conversations of rows(conv_id, turn, role, text).

    Rows are taken by turn, nulls first, and those of one turn by role and text. A null role or text is one space. A
    null conv_id is a conversation of its own. Only a role that begins with s, u or a can be kept, where it fits. Rows that are
    equal are rows each, all but the first duplicates. Other columns aren't read. An empty table gives empty results.
    """
    small_batches(rows.sparkSession)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    placed = ranked(rows.select("conv_id", "turn", part("role"), part("text")), ["conv_id"], ["turn", "role", "text"], "pos")
    placed = stash(placed, "rows")
    marked = stash(faults(placed), "marked")
    return Repair(placed, marked, stash(plans(marked), "plans"))


def summary(ids: DataFrame, done: Repair) -> DataFrame:
    """A row for each conv_id of ids: counts, illegal, cost, audit and repaired_sha256. Without rows: zeros, no audit, the digest of nothing."""
    kept = ids.select("conv_id").distinct()
    for k, more in enumerate((done.counts(), done.plan, done.digests())):
        more = more.withColumnRenamed("conv_id", f"_conv{k}")
        kept = kept.join(more, F.col("conv_id").eqNullSafe(F.col(f"_conv{k}")), "left").drop(f"_conv{k}")
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return kept.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zero), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
