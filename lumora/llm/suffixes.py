"""Suffix-array dedup: a logarithmic family of sparse suffix arrays finds long repeated strings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import binaries, dropped, in_order, narrowed, new_path, numbers, removed, runs, sliced, written

#: Bytes of a suffix's own prefix, by whose fingerprint a suffix array is ordered.
PREFIX = 40
#: Bytes of texts that are sampled at a time.
BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0x2545F4914F6CDD1D
_SIGNS = np.random.Generator(np.random.PCG64(200)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: A string on its way to its slot: its fingerprint, its row, its place there (-1: not to be settled), how often it was met (2: at least).
STRING = np.dtype([("key", "<i8"), ("uid", "<i8"), ("also", "<i4"), ("at", "<i4"), ("n", "<i4")])


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, x in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                steps = np.full(n, x, dtype=np.uint64)
                steps[:1] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Strings:
    """Fingerprints of the substrings of a byte array, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_SIGNS[data] * up[:-1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(x)] = x
    tiles = padded.reshape(-1, width)
    front = np.minimum.accumulate(tiles, axis=1).ravel()
    back = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, bounds: np.ndarray, length: int, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """The suffixes that stand for all strings of `length` bytes of the texts between bounds.

    Each such string is stood for by the suffix, starting within it, whose prefix has the
    least fingerprint (the first of equals): equal strings have it at the same place. Places
    take 24 bits, so the texts are under 16 MiB together. Returned
    are, for each suffix, the fingerprint of its prefix, one of all bytes that its strings
    cover, the first string's start and the number of strings, which follow one another.
    """
    if len(data) < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    of = Strings(data)
    grams = of.all(prefix)
    order = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(order, length - prefix + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    inside = np.ones(len(place), dtype=bool)
    for end in bounds[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    own = place[starts]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    count = np.diff(np.append(new, len(starts)))
    at, first = own[new], starts[new]
    covered = of(first, first + count - 1 + length)
    return grams[at], mixed(covered ^ ((at - first).astype(np.uint64) * _ODD) ^ (count.astype(np.uint64) << np.uint64(48))), first, count


def _cut(texts: list[bytes], length: int, size: int = BLOCK) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of pieces (text, offset, bytes) of about `size` bytes together.

    A longer text is cut into pieces that overlap by length - 1 bytes, so that each string
    of `length` bytes lies in just one.
    """
    block, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), size):
            piece = text[at : at + size + length - 1] if at or len(text) > size else text
            if held and held + len(piece) > size:
                yield block
                block, held = [], 0
            block.append((i, at, piece))
            held += len(piece)
    if block:
        yield block


def _joined(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null: empty), uid and also: 96 bits of hashes of both, which only equal rows share; rest: the other columns by place."""
    others = [docs[x].alias(f"c{i}") for i, x in enumerate(docs.columns) if x not in (id_col, text_col)]
    rest = F.struct(F.lit(True).alias("row"), *others)
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), rest.alias("rest"))
    both = [F.col("doc_id").cast("string"), F.lit("\0"), F.col("text")]
    return rows.withColumns({"uid": F.xxhash64(*both), "also": F.hash(*both)})


def suffixes(rows: DataFrame, length: int) -> DataFrame:
    """uid, also, at, strings, prefix, covered: the sampled suffixes of the rows of identified().

    `at` is the first string of `length` bytes that a suffix stands for, `strings` their number.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            uid, also, texts = numbers(batch.column("uid")), numbers(batch.column("also"), "int32"), binaries(batch.column("text"))
            for block in _cut(texts, length):
                text, offset, pieces = zip(*block, strict=True)
                data, bounds = _joined(pieces)
                prefix, covered, first, count = sampled(data, bounds, length)
                own = np.searchsorted(bounds, first, side="right") - 1
                # empty texts share a bound with the next; the last of equals is the text that holds it
                at, row = first - bounds[own] + np.array(offset)[own], np.array(text)[own]
                yield {
                    "uid": pa.array(uid[row]), "also": pa.array(also[row]), "at": pa.array(at.astype(np.int32)), "strings": pa.array(count.astype(np.int32)),
                    "prefix": pa.array(prefix.view(np.int64)), "covered": pa.array(covered.view(np.int64)),
                }

    names = ["uid", "also", "at", "strings", "prefix", "covered"]
    return rows.select("uid", "also", "text").where(F.octet_length("text") >= length).mapInArrow(
        in_order(names, body), "uid long, also int, at int, strings int, prefix long, covered long"
    )


class SuffixIndex:
    """Suffix arrays in levels; each of level k holds 2^k batches.

    A suffix array is a table of sampled suffixes in the order of their prefixes, equal ones
    counted. A new batch's array is merge-scanned against the levels: prefixes that occur
    again, in the batch or in a level, are the hits. Then it becomes a level, and as long
    as there are two levels of one size, they merge into the next. A batch is thus rewritten
    once for each doubling of the index.
    """

    def __init__(self, spark):
        self.spark, self.levels, self.hits = spark, [], []

    def _array(self, rows: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(self.spark, "suffix-array")
        rows.groupBy("prefix", "covered").agg(F.sum("n").alias("n")).sortWithinPartitions("prefix").write.parquet(path)
        return path, self.spark.read.schema("prefix long, covered long, n long").parquet(path)

    def insert(self, batch: DataFrame) -> None:
        """Add the suffixes (prefix, covered) of new documents."""
        path, new = self._array(batch.select("prefix", "covered", F.lit(1).cast("long").alias("n")))
        merged = new.select("prefix", F.col("n").alias("new"), F.lit(0).cast("long").alias("old"))
        for _, _, level in self.levels:
            merged = merged.unionByName(level.select("prefix", F.lit(0).cast("long").alias("new"), F.col("n").alias("old")))
        merged = merged.groupBy("prefix").agg(F.sum("new").alias("new"), F.sum("old").alias("old"))
        self.hits.append(written(merged.where("new > 0 and new + old > 1").select("prefix"), "hits"))
        self.levels.append((0, path, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, old_path, old), (_, path, new) = self.levels[-2:]
            self.levels[-2:] = [(size + 1, *self._array(old.unionByName(new)))]
            removed(self.spark, old_path)
            removed(self.spark, path)

    def repeated(self) -> DataFrame:
        """prefix, covered, n, mixed of the suffixes whose prefix occurs again; n > 1 if all they cover does.

        `mixed` tells that some suffix of that prefix covers bytes that no other covers whole.
        """
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        found = self.levels[0][2]
        for _, _, level in self.levels[1:]:
            found = found.unionByName(level)
        found = found.join(hits.distinct(), "prefix", "left_semi")
        found = written(found.groupBy("prefix", "covered").agg(F.sum("n").alias("n")), "repeated")
        self.found = found
        return found.join(found.groupBy("prefix").agg((F.min("n") == 1).alias("mixed")), "prefix")

    def close(self) -> None:
        """Delete the index, once nothing reads it any more."""
        for _, path, _ in self.levels:
            removed(self.spark, path)
        dropped(*self.hits, self.found)


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts with their prefixes: a fingerprint of each string, its row and its place there."""
    texts = binaries(batch.column("context"))
    data, bounds = _joined(texts)
    of = Strings(data)
    count = np.diff(bounds) - length + 1
    row = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[row] + place
    prefix = numbers(batch.column("prefix")).view(np.uint64)[row]
    return mixed(of(start, start + length) ^ (prefix * _ODD)).view(np.int64), row, place


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, batches: int = 4, part: int = 1000, slot: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """The rows of identified(), and uid, also, a, b: byte ranges covered by strings of `length` that start anywhere else too.

    The documents enter a SuffixIndex in `batches` batches. Suffixes with equal covered
    bytes settle at once; where a prefix occurs again among other bytes, the strings
    of each distinct context are compared one by one. A prefix of up to `part` contexts is
    compared in one place. The strings of more common ones are first compared within each
    batch, and then each distinct one goes once, whatever its prefix, to the slot of its
    fingerprint; slots hold about `slot` strings. Ranges of a document overlap; those of
    equal rows come once or more.
    """
    rows = identified(docs, id_col, text_col)
    placed = written(suffixes(rows, length), "suffixes")
    index = SuffixIndex(docs.sparkSession)
    for k in range(batches):
        index.insert(placed.where(F.pmod("uid", F.lit(batches)) == k))
    again = placed.join(index.repeated(), ["prefix", "covered"])
    again = written(again, "repeated-suffixes")
    index.close()
    dropped(placed)
    settled = again.where("n > 1").select("uid", "also", F.col("at").alias("a"), (F.col("at") + F.col("strings") - 1 + length).alias("b"))
    # one place for each distinct context of a prefix that has unsettled ones
    contexts = again.where("mixed").groupBy("prefix", "covered").agg(F.min(F.struct("uid", "also", "at", "strings", "n")).alias("s"))
    crowds = contexts.groupBy("prefix").agg((F.count(F.lit(1)) > part).alias("crowd"))
    asked = contexts.join(crowds, "prefix").select("prefix", "crowd", "s.*")
    asked = asked.groupBy("uid", "also").agg(F.collect_list(F.struct("prefix", "crowd", "at", "strings", "n")).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            found: list[tuple] = []
            uids, alsos = batch.column("uid").to_pylist(), batch.column("also").to_pylist()
            for uid, also, text, wanted in zip(uids, alsos, binaries(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
                for x in wanted:
                    at = x["at"]
                    found.append((x["prefix"], x["crowd"], uid, also, at, x["n"] == 1, text[at : at + x["strings"] - 1 + length]))
            if found:
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
                yield dict(zip(names, map(pa.array, zip(*found, strict=True), kinds), strict=True))

    names = ["prefix", "crowd", "uid", "also", "at", "open", "context"]
    # one of equal rows shows the bytes, the first of each task and then of these
    known = rows.select("uid", "also", "text").join(asked, ["uid", "also"]).dropDuplicates(["uid", "also"]).select("uid", "also", "text", "asked")
    contexts = written(known.mapInArrow(in_order(names, fetch), "prefix long, crowd boolean, uid long, also int, at int, open boolean, context binary"), "contexts")

    def ranges(uid: np.ndarray, also: np.ndarray, start: np.ndarray) -> dict:
        """Runs of strings that follow one another, sorted by row and start."""
        other = (uid[1:] != uid[:-1]) | (also[1:] != also[:-1])
        new = np.flatnonzero(np.concatenate(([True], other | (start[1:] != start[:-1] + 1)))) if len(uid) else np.zeros(0, int)
        last = np.append(new[1:], len(uid))[: len(new)] - 1
        return {"uid": pa.array(uid[new]), "also": pa.array(also[new].astype(np.int32)), "a": pa.array(start[new].astype(np.int32)), "b": pa.array((start[last] + length).astype(np.int32))}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, _ in runs(batches, ["prefix"]):
            batch = table.combine_chunks().to_batches()[0]
            key, row, place = _windows(batch, length)
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            hit = (count[inverse] > 1) & batch.column("open").to_numpy(zero_copy_only=False)[row]
            row, place = row[hit], place[hit]
            yield ranges(numbers(batch.column("uid"))[row], numbers(batch.column("also"))[row], numbers(batch.column("at"))[row] + place)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            key, row, place = _windows(batch, length)
            uid, also, at = (numbers(batch.column(x))[row] for x in ("uid", "also", "at"))
            at = at + place
            own = batch.column("open").to_numpy(zero_copy_only=False)[row]
            _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            hit = (count[inverse] > 1) & own
            met = ranges(uid[hit], also[hit], at[hit])
            n = len(met["uid"])
            yield met | {"slot": pa.array([None] * n, pa.int64()), "strings": pa.array([None] * n, pa.binary())}
            # each distinct string with its owner, if only one place of the batch is open to be settled
            sent = np.zeros(len(first), dtype=STRING)
            alone = (count == 1) & own[first]
            sent["key"], sent["n"] = key[first], np.minimum(count, 2)
            sent["uid"], sent["also"], sent["at"] = uid[first], also[first], np.where(alone, at[first], -1)
            to = (((sent["key"].view(np.uint64) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.diff(to[order], prepend=-1))
            parts = [sent[i].tobytes() for i in np.split(order, cut[1:])] if len(order) else []
            yield {
                "uid": pa.nulls(len(parts), pa.int64()), "also": pa.nulls(len(parts), pa.int32()), "a": pa.nulls(len(parts), pa.int32()), "b": pa.nulls(len(parts), pa.int32()),
                "slot": pa.array(to[order][cut] if len(order) else none), "strings": pa.array(parts, pa.binary()),
            }

    def settle(table: pa.Table) -> pa.Table:
        sent = np.frombuffer(b"".join(table.column("strings").to_pylist()), dtype=STRING)
        _, inverse = np.unique(sent["key"], return_inverse=True)
        hit = sent[(np.bincount(inverse, sent["n"])[inverse] > 1) & (sent["at"] >= 0)]
        hit = hit[np.lexsort((hit["at"], hit["also"], hit["uid"]))]
        return pa.table(ranges(*(hit[x].astype(np.int64) for x in ("uid", "also", "at"))))

    few = contexts.where("not crowd").repartition("prefix").sortWithinPartitions("prefix").select("prefix", "uid", "also", "at", "open", "context")
    few = few.mapInArrow(in_order(["uid", "also", "a", "b"], compare), "uid long, also int, a int, b int")
    many = contexts.where("crowd")
    slots = -(-(many.agg(F.sum(F.octet_length("context") - length + 1)).first()[0] or 0) // slot) or 1
    met = many.mapInArrow(in_order(["uid", "also", "a", "b", "slot", "strings"], meet), "uid long, also int, a int, b int, slot long, strings binary")
    met = written(met, "met-strings")
    many = met.where("slot is null").select("uid", "also", "a", "b").unionByName(
        met.where("slot is not null").select("slot", "strings").groupBy("slot").applyInArrow(settle, "uid long, also int, a int, b int")
    )
    return rows, settled.unionByName(few).unionByName(many)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """doc_id, left (the bytes that stay), n_bytes, spans (start, end of each removed run), rest (other columns).

    Removed is each byte that a string of `length` bytes covers which starts anywhere else
    too, in the same document or another; all copies go, judged on the input. Null texts
    count as empty, shorter ones stay as they are, repeated rows are copies of each other.
    An empty table gives none. `options` are those of spans().
    """
    rows, found = spans(docs, **options)
    # a set, as equal rows share their ranges: each task keeps one of each before the shuffle
    found = found.groupBy("uid", "also").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            texts, left, cuts = binaries(batch.column("text")), [], []
            for text, ranges in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                runs_: list[list[int]] = []
                for a, b in sorted((x["a"], x["b"]) for x in ranges or ()):
                    if runs_ and a <= runs_[-1][1]:
                        runs_[-1][1] = max(b, runs_[-1][1])
                    else:
                        runs_.append([a, b])
                edges = [0, *(x for run in runs_ for x in run), len(text)]
                left.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                cuts.append([{"start": a, "end": b} for a, b in runs_])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield {"doc_id": batch.column("doc_id"), "rest": batch.column("rest"), "left": pa.array(left, pa.binary()), "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "spans": pa.array(cuts, span)}

    kinds = {x: rows.schema[x].dataType.simpleString() for x in ("doc_id", "rest")}
    return rows.join(found, ["uid", "also"], "left").mapInArrow(
        in_order(["doc_id", "rest", "left", "n_bytes", "spans"], body),
        f"doc_id {kinds['doc_id']}, rest {kinds['rest']}, left binary, n_bytes long, spans array<struct<start: long, end: long>>",
    )


def cleaned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with the text that deduplicated() leaves; a letter that a cut parts goes whole."""
    found = deduplicated(docs, id_col=id_col, text_col=text_col, **options)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            texts = [x.decode("utf-8", "ignore") for x in binaries(batch.column("left"))]
            yield {"doc_id": batch.column("doc_id"), "rest": batch.column("rest"), "text": pa.array(texts, pa.string())}

    kinds = {x: found.schema[x].dataType.simpleString() for x in ("doc_id", "rest")}
    texts = found.select("doc_id", "rest", "left").mapInArrow(
        in_order(["doc_id", "rest", "text"], body), f"doc_id {kinds['doc_id']}, rest {kinds['rest']}, text string"
    )
    given = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return texts.select(*[(given[x] if x in given else F.col("rest").getField(f"c{i}")).alias(x) for i, x in enumerate(docs.columns)])
