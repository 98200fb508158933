"""Conversation prefix trie: which conversations begin with the same turns, and what sharing them saves.

Turns lie sorted by conversation and place over the partitions. Each gets the polynomial
fingerprint of the turns up to it by a numpy scan; partitions hand over what a conversation
that goes on in the next one has reached, two rows each, so a conversation of any length is
scanned in parts. Turns of one depth and fingerprint are a candidate group. Every turn of it is verified
against the representative's by a SHA-256 digest, which, from the root on, makes whole prefixes equal;
where turns differ, the group and all below it are split. A node's subtree sums are sums
over its members of suffix sums along their own turns, so no level waits for another.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import binaries, dropped, in_order, narrowed, numbers, sliced, written

#: Two primes under 2**31 and the bases of the polynomials over them: fingerprints of 62 bits.
MODULI = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_103_515_245, 1_664_525_017)
#: Numbers in a packed row of a node's last conversations.
PACKED = 1 << 16

Values = tuple[int, ...]


class Scan:
    """Running values over rows sorted by conversation: a count, and polynomials of `values` (or plain sums, without moduli)."""

    def __init__(self, moduli: Values | None, wide: int = 2):
        self.moduli, self.wide = moduli, len(moduli) if moduli else wide
        self.last, self.at = None, (0,) * (self.wide + 1)

    def step(self, conv: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """Count and values after each row of the next batch."""
        new = np.ones(len(conv), dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.flatnonzero(new)
        sizes = np.diff(np.append(start, len(conv)))
        place = np.arange(len(conv)) - np.repeat(start, sizes) + 1
        found = [place]
        for i, x in enumerate(values):
            if not self.moduli:
                total = np.cumsum(x)
                found.append(total - np.repeat(total[start] - x[start], sizes))
                continue
            p = self.moduli[i]
            forth, back = powers(BASES[i], int(place.max()), p), powers(pow(BASES[i], -1, p), int(place.max()), p)
            scaled = x % p * back[place] % p
            total = np.cumsum(scaled)
            found.append((total - np.repeat(total[start] - scaled[start], sizes)) % p * forth[place] % p)
        if self.last == int(conv[0]):
            first = slice(0, int(sizes[0]))
            for x, y in zip(found, self.after(self.at, [x[first] for x in found]), strict=True):
                x[first] = y
        self.last, self.at = int(conv[-1]), tuple(int(x[-1]) for x in found)
        return found

    def after(self, before: Values, then: list) -> list:
        """What `then` (count and values of a stretch) comes to after a stretch of `before`; also for arrays."""
        found = [before[0] + then[0]]
        for i, (x, y) in enumerate(zip(before[1:], then[1:], strict=True)):
            found.append((x * power(BASES[i], then[0], self.moduli[i]) + y) % self.moduli[i] if self.moduli else x + y)
        return found


def powers(base: int, most: int, p: int) -> np.ndarray:
    """base**0 ... base**most modulo p."""
    found = np.ones(1, dtype=np.int64)
    while len(found) <= most:
        found = np.concatenate((found, found * pow(base, len(found), p) % p))
    return found


def power(base: int, exponents, p: int):
    """base**exponents modulo p, for a number or an array."""
    if isinstance(exponents, int):
        return pow(base, exponents, p)
    found, factor, left = np.ones(len(exponents), dtype=np.int64), base % p, exponents.copy()
    while left.any():
        found = np.where(left & 1, found * factor % p, found)
        factor, left = factor * factor % p, left >> 1
    return found


def scanned(rows: DataFrame, values: Callable, made: dict[str, str], scan: Callable[[], Scan], what: str) -> DataFrame:
    """A written table of sorted rows with `values`' columns, k and v1, v2...: count and values since the conversation's first row.

    values(batch) gives the arrays to scan and the columns to keep (typed in `made`). Each partition is
    scanned by itself, then what the ones before it have reached for its first conversation is added.
    """
    wide = scan().wide
    got = ["k", *(f"v{i + 1}" for i in range(wide))]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state, part = scan(), TaskContext.get().partitionId()
        for batch in sliced(batches, 5000):
            conv = numbers(batch.column("conv"))
            arrays, kept = values(batch)
            yield {"part": pa.array(np.full(len(conv), part, dtype=np.int32)), "conv": batch.column("conv")} | kept | dict(
                zip(got, map(pa.array, state.step(conv, arrays)), strict=True)
            )

    schema = "part int, conv long, " + "".join(f"{k} {v}, " for k, v in made.items()) + ", ".join(f"{x} long" for x in got)
    table = written(rows.mapInArrow(in_order(["part", "conv", *made, *got], own), schema), what)
    # each partition's first and last conversation, at their last rows there
    first = F.min(F.struct("conv", (-F.col("k")).alias("less"), *got[1:])).alias("first")
    edges = table.groupBy("part").agg(first, F.max(F.struct("conv", *got)).alias("last")).orderBy("part").collect()
    reached, conv, at, state = {}, None, None, scan()
    for part, (begins, less, *x), (ends, *y) in edges:
        x = [-less, *x]
        if conv == begins:
            reached[part] = conv, at
            x = state.after(at, x)
        conv, at = ends, tuple(x if begins == ends else y)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state = scan()
        for batch in batches:
            conv, part = numbers(batch.column("conv")), numbers(batch.column("part"))
            found = [numbers(batch.column(x)).copy() for x in got]
            for p in np.unique(part).tolist():
                if p in reached:
                    on = np.flatnonzero((part == p) & (conv == reached[p][0]))
                    for x, y in zip(found, state.after(reached[p][1], [x[on] for x in found]), strict=True):
                        x[on] = y
            yield {"conv": batch.column("conv")} | {k: batch.column(k) for k in made} | dict(zip(got, map(pa.array, found), strict=True))

    found = table.mapInArrow(in_order(["conv", *made, *got], whole), schema.partition(", ")[2]) if reached else table.drop("part")
    found.lumora_path = table.lumora_path
    return found


def _parts(digests: list[bytes]) -> list[np.ndarray]:
    """Two numbers for each turn, which its place in the polynomials takes."""
    both = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)
    return [(both[:, i] >> np.uint64(2)).astype(np.int64) for i in (0, 1)]


def ordered(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv, place (from 1), seen (SHA-256 of role and text), words: every turn in its conversation.

    Turns are ordered by turn (null first), equal ones by role and text; null roles and texts
    are empty, equal rows are turns each. Rows without a conversation's number are left out.
    """
    rows = narrowed(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null").select(
        F.col("conv").cast("long"), "turn", *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text"))
    )

    def values(batch: pa.RecordBatch) -> tuple[list, dict]:
        roles, texts = binaries(batch.column("role")), binaries(batch.column("text"))
        seen = [hashlib.sha256(b"%d:%b%b" % (len(x), x, y)).digest() for x, y in zip(roles, texts, strict=True)]
        return [], {"seen": pa.array(seen), "words": pa.array([len(x.split()) for x in texts], pa.int64())}

    order = ["conv", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = scanned(rows, values, {"seen": "binary", "words": "long"}, lambda: Scan(None, 0), "turns")
    made = found.withColumnRenamed("k", "place")
    made.lumora_path = found.lumora_path
    return made


def with_heads(found: DataFrame, *, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that share beginnings: each takes its first h turns from the one whose number is the multiple of `every` at or under it.

    h is the CRC-32 of the decimal number modulo `most`. The rows are those of ordered(); places keep
    their order and may have gaps. All conversations stay in the second result, even where no turn is left.
    """
    convs = found.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", _head("conv", most).alias("h"))
    heads = found.where((F.col("conv") % every == 0) & (F.col("place") < most)).select(F.col("conv").alias("from"), "place", "seen", "words")
    taken = convs.withColumn("from", F.col("conv") - F.col("conv") % every).join(heads, "from").where("place <= h")
    own = found.where(F.col("place") > _head("conv", most))
    return own.select("conv", "place", "seen", "words").unionByName(taken.select("conv", "place", "seen", "words")), convs.select("conv")


def _head(conv: str, most: int) -> Column:
    return F.crc32(F.col(conv).cast("string")) % most


KEY = ["depth", "fp", "split"]


def nodes(turns: DataFrame, convs: DataFrame, *, moduli: Values = MODULI) -> DataFrame:
    """The trie of conversations: a row for each distinct sequence of first turns, from the textless root on.

    `turns` has conv, place (unique in a conversation), seen and words, `convs` the numbers of all
    conversations, those without turns too. conv_id is the smallest member, parent_conv_id that of the
    parent (root: null); n_convs, n_children, n_leaves (childless nodes of the subtree, itself included),
    saved_tokens (over the subtree, words of a node's last text for each member but one), and ends_sha256 over
    the ascending decimal numbers of the members that end here. No conversations give no rows.
    """
    def values(batch: pa.RecordBatch) -> tuple[list, dict]:
        return _parts(binaries(batch.column("seen"))), {x: batch.column(x) for x in ("seen", "words")}

    scan = scanned(
        turns.repartitionByRange("conv", "place").sortWithinPartitions("conv", "place"), values, {"seen": "binary", "words": "long"},
        lambda: Scan(moduli), "prefixes",
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The fingerprint, and that of the turns before: the turn's number is taken off again."""
        for batch in batches:
            now = [numbers(batch.column(x)) for x in ("v1", "v2")]
            own = _parts(binaries(batch.column("seen")))
            before = [(x - y % p) % p * pow(b, -1, p) % p for x, y, p, b in zip(now, own, moduli, BASES, strict=True)]
            yield {"conv": batch.column("conv"), "depth": batch.column("k"), "seen": batch.column("seen"), "words": batch.column("words")} | {
                name: pa.array((x[0] << 31) | x[1]) for name, x in (("fp", now), ("up", before))
            }

    names = ["conv", "depth", "seen", "words", "fp", "up"]
    rows = scan.mapInArrow(in_order(names, keyed), "conv long, depth long, seen binary, words long, fp long, up long")
    root = {"depth": F.lit(0).cast("long"), "seen": F.lit(b""), "words": F.lit(0).cast("long"), "fp": F.lit(0).cast("long"), "up": F.lit(None).cast("long")}
    rows = rows.unionByName(convs.select("conv", *(v.alias(k) for k, v in root.items())))
    rows = _split(rows)
    group = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min("up").alias("up"), F.min("up_split").alias("up_split")
    )
    group = written(group, "nodes")
    children = group.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp"), F.col("up_split").alias("split"))
    group = group.join(children.agg(F.count(F.lit(1)).alias("n_children")), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    group = written(group, "children")

    # each node's own share stands at its representative's row
    share = group.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    held = rows.select("conv", *KEY).join(share, ["conv", "depth"], "left").na.fill(0, ["saved", "leaf"])
    down = held.repartitionByRange("conv", F.desc("depth")).sortWithinPartitions("conv", F.desc("depth"))

    def shares(batch: pa.RecordBatch) -> tuple[list, dict]:
        return [numbers(batch.column(x)) for x in ("saved", "leaf")], {x: batch.column(x) for x in KEY}

    below = scanned(down, shares, {"depth": "long", "fp": "long", "split": "string"}, lambda: Scan(None, 2), "shares")
    sums = below.groupBy(*KEY).agg(F.sum("v1").alias("saved_tokens"), F.sum("v2").alias("n_leaves"))
    last = below.where("k = 1").select("conv", *KEY)  # a conversation's deepest row comes first
    parents = group.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"), F.col("split").alias("up_split"), F.col("conv").alias("parent_conv_id"))
    found = group.join(parents, ["depth", "up", "up_split"], "left").join(sums, KEY).join(_digests(last), KEY, "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _split(rows: DataFrame) -> DataFrame:
    """The rows with split and up_split: empty, or what tells prefixes of one fingerprint apart.

    In a group whose turns all equal the representative's, the turns before them have one fingerprint
    too; so if no group holds different turns, all prefixes of a group are equal. Where one does, each of
    its turns is told apart by its digest, and the conversations that pass it carry that on to all their
    later turns.
    """
    seen = rows.groupBy("depth", "fp").agg(F.min("seen").alias("a"), F.max("seen").alias("b")).where("a <> b").select("depth", "fp")
    seen = written(seen, "collisions")
    if seen.isEmpty():
        return rows.select("*", F.lit("").alias("split"), F.lit("").alias("up_split"))
    passed = rows.join(seen, ["depth", "fp"], "left_semi").select("conv", F.struct("depth", F.hex("seen").alias("seen")).alias("at"))
    passed = passed.groupBy("conv").agg(F.array_sort(F.collect_list("at")).alias("passed"))

    def told(depth: Column) -> Column:
        before = F.filter(F.coalesce("passed", F.array().cast("array<struct<depth:long,seen:string>>")), lambda x: x["depth"] <= depth)
        return F.when(F.size(before) > 0, F.sha2(F.array_join(F.transform(before, lambda x: F.concat_ws(":", x["depth"], x["seen"])), ","), 256)).otherwise("")

    joined = rows.join(passed, "conv", "left")
    return joined.select(*rows.columns, told(F.col("depth")).alias("split"), told(F.col("depth") - 1).alias("up_split"))


def _digests(last: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the numbers of each node's last conversations, ascending and joined by commas.

    A node's numbers are packed in sorted rows of up to PACKED, compressed, by many tasks; one
    task then reads these rows in their order and hashes them as a stream, as SHA-256 needs.
    """
    order = [*KEY, "conv"]

    def runs(batches: Iterator[pa.RecordBatch], body: Callable) -> Iterator[dict]:
        """body(key, items) for each run of equal keys, in parts as the batches have it; `None` ends a run."""
        now = None
        for batch in batches:
            for *key, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        yield from body(now, None)
                    now = key
                yield from body(now, x)
        if now is not None:
            yield from body(now, None)

    def batched(rows: Iterator[tuple], names: list[str], types: list) -> Iterator[dict]:
        held = []
        for row in rows:
            held.append(row)
            if len(held) >= 1000:
                yield dict(zip(names, map(pa.array, zip(*held, strict=True), types), strict=True))
                held = []
        if held:
            yield dict(zip(names, map(pa.array, zip(*held, strict=True), types), strict=True))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[int] = []

        def body(key: list, conv: int | None) -> Iterator[tuple]:
            if held and (conv is None or len(held) == PACKED):
                yield (*key, held[0], zlib.compress(",".join(map(str, held)).encode()))
                held.clear()
            if conv is not None:
                held.append(conv)

        yield from batched(runs(batches, body), [*order, "ids"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state: list = []

        def body(key: list, ids: bytes | None) -> Iterator[tuple]:
            if ids is None:
                yield (*key, state.pop().hexdigest())
                return
            if state:
                state[0].update(b",")
            else:
                state.append(hashlib.sha256())
            state[0].update(zlib.decompress(ids))

        yield from batched(runs(batches, body), [*KEY, "ends_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    key = "depth long, fp long, split string, "
    rows = last.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    packed = rows.mapInArrow(in_order([*order, "ids"], pack), key + "conv long, ids binary")
    packed = packed.repartition(*KEY).sortWithinPartitions(*order).select(*KEY, "ids")
    return packed.mapInArrow(in_order([*KEY, "ends_sha256"], digest), key + "ends_sha256 string")
