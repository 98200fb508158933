"""Filter, map, flat-map, join, aggregate and group-by by instruction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.relational import cell_join, running
from lumora.plans.fitting import LEAST, Fitter, room
from lumora.plans.judges import Field, Judge, Unanswered, fresh, parse_boolean, parse_json, retried
from lumora.tables import sliced


def sem_filter(
    df: DataFrame, condition: str, judge: Judge, *, columns: list[str] | None = None, errors: str | None = None, sides: tuple[tuple[str, ...], ...] = ()
) -> DataFrame:
    """Rows for which the condition holds, unchanged; a null of a rule drops the row. `sides` are fields that share the context evenly.

    So does a record that the model gives no answer to, unless `errors` names a column: then
    such rows stay, with what went wrong (null for the others).
    """
    native = judge.rule(condition, df)
    if native is not None:
        found = df.where(F.coalesce(native, F.lit(False)))
        return found.withColumn(errors, F.lit(None).cast("string")) if errors else found
    asked, reply, error = judge.ask(df, f"Is this true of the record? {condition}", columns or df.columns, parse_boolean, sides=sides)
    if not errors:
        return asked.where(F.col(reply) == "true").select(df.columns)
    return asked.where((F.col(reply) == "true") | F.col(error).isNotNull()).select(*df.columns, F.col(error).alias(errors))


def _nested(kind: str) -> bool:
    return kind.lower().startswith(("array", "map", "struct"))


def _schema(fields: list[Field]) -> str:
    return ", ".join(f"`{f.name}`: {f.type if _nested(f.type) else 'string'}" for f in fields)


def _cast(record: Column, fields: list[Field]) -> dict[str, Column]:
    """The fields of a reply's record: plain types are cast from whatever JSON holds, null where that fails."""
    return {f.name: record.getField(f.name) if _nested(f.type) else record.getField(f.name).try_cast(f.type) for f in fields}


def _given(reply: str, fields: list[Field]) -> dict[str, Column]:
    return _cast(F.from_json(F.col(reply), f"struct<{_schema(fields)}>"), fields)


def _task(task: str, fields: list[Field]) -> str:
    return f"{task} Fields: " + "; ".join(f"{f.name} ({f.type}): {f.description}" for f in fields)


def sem_map(df: DataFrame, fields: list[Field], judge: Judge, *, columns: list[str] | None = None, errors: str | None = None) -> DataFrame:
    """df with each field computed from its row; a field of the same name is replaced, a missing one null.

    Fields whose description is a rule are native columns; the rest come from one call a
    distinct record. `errors` names a column for what went wrong.
    """
    native = {f.name: judge.rule(f.description, df) for f in fields}
    open_ = [f for f in fields if native[f.name] is None]
    known = {f.name: native[f.name].try_cast(f.type) for f in fields if native[f.name] is not None}
    failed = F.lit(None).cast("string")
    if open_:
        asked, reply, error = judge.ask(df, _task("Compute the fields of the record as a JSON object.", open_), columns or df.columns, parse_json)
        given, new = _given(reply, open_), {f.name for f in open_}
        df = asked.select(
            *[F.col(f"`{c}`") for c in df.columns if c not in new], *[given[f.name].alias(f.name) for f in open_], *([F.col(error).alias(errors)] if errors else [])
        )
    df = df.withColumns(known) if known else df
    return df.withColumn(errors, failed) if errors and not open_ else df


def sem_flat_map(
    df: DataFrame, fields: list[Field], judge: Judge, task: str, *, columns: list[str] | None = None, errors: str | None = None
) -> DataFrame:
    """A row for each record that the task finds in a row, with the row's other columns; none drops the row.

    A rule gives an array of structs; its fields win over columns of the same name. With
    `errors`, a row without an answer stays once, its fields null, with what went wrong.
    """
    found, error = judge.rule(task, df), None
    if found is None:
        df_, reply, error = judge.ask(df, _task(f"{task} Answer with a JSON array of objects.", fields), columns or df.columns, parse_json)
        records = F.from_json(F.col(reply), f"array<struct<{_schema(fields)}>>")
        found = F.transform(records, lambda r: F.struct(*[c.alias(name) for name, c in _cast(r, fields).items()]))
    else:
        df_ = df
    rest = [F.col(f"`{c}`") for c in df.columns if c not in {f.name for f in fields}]
    if errors:
        nothing = F.struct(*[F.lit(None).cast(f.type).alias(f.name) for f in fields])
        failed = F.col(error) if error else F.lit(None).cast("string")
        found, rest = F.when(failed.isNotNull(), F.array(nothing)).otherwise(found), [*rest, failed.alias(errors)]
    of = [c for c in df.columns if c not in {f.name for f in fields}] + ([errors] if errors else [])
    return df_.select(*rest, F.inline(found)).select(*[F.col(f"`{c}`") for c in of], *[f.name for f in fields])


def sem_join(
    left: DataFrame, right: DataFrame, condition: str, judge: Judge, *, on: list[tuple[str, str]] | None = None, errors: str | None = None
) -> DataFrame:
    """Pairs for which the condition holds; columns of both sides become left_x and right_x, others keep their name.

    A rule names the columns that must be equal and a residual. A model judges only pairs that
    agree on the columns `on`; without them a join would compare all pairs, so it is refused. In a
    prompt over the judge's context each side has half of the room. Pairs are dealt evenly, see cell_join().
    """
    shared = set(left.columns) & set(right.columns)
    of_left = lambda c: f"left_{c}" if c in shared else c
    of_right = lambda c: f"right_{c}" if c in shared else c
    a, b = left.withColumnsRenamed({c: of_left(c) for c in left.columns}), right.withColumnsRenamed({c: of_right(c) for c in right.columns})
    rule = judge.rules.get(condition)
    equal = rule().equal if rule else tuple(on or ())
    if not equal:
        raise Unanswered(f"a join needs columns to block on: {condition}")
    keys = [(of_left(x), of_right(y)) for x, y in equal]
    if rule:
        residual = rule().residual
        read: tuple[dict, dict] = {}, {}  # the columns that the residual asks for, each once
        of = [lambda c, name=name, seen=seen: F.col(seen.setdefault(name(c), name(c))) for name, seen in zip((of_left, of_right), read, strict=True)]
        found = cell_join(a, b, keys, residual(*of) if residual else None, order=tuple(map(list, read)))
        return found.withColumn(errors, F.lit(None).cast("string")) if errors else found
    return sem_filter(cell_join(a, b, keys), condition, judge, errors=errors, sides=(tuple(a.columns), tuple(b.columns)))


#: The built-in aggregates; sums and means are of doubles, a sum of nothing is 0, count counts rows.
AGGREGATES = {
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(F.lit(1)),
    "sum": lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)),
    "mean": lambda c: F.avg(F.col(c).cast("double")),
}


#: A pack's text but for its records, and how often a record is escaped there.
_EMPTY, _WRAPS = '\n{"records":"[]"}', 2
#: Records of at most this share of a pack are dealt together, by size; larger ones have a pack each.
_SIZES = (2, 4, 8)


def _fitted(rows: DataFrame, prompt: str, judge: Judge, limit: int) -> DataFrame:
    """The rows, with `cost`: the characters that their record takes in a pack, at most `limit`, to which longer records are cut."""
    fitter = Fitter(prompt, judge.embed, wraps=_WRAPS, batch=judge.batch)
    cost = F.length(F.to_json(F.struct(F.to_json(F.array("record")).alias("records")))) - len(_EMPTY) + 2  # a comma, and no line end

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            at = batch.schema.get_field_index("record")
            short = pa.array([fitter.fit(x, limit - 5) for x in batch.column(at).to_pylist()], pa.string())  # 4 for its quotes, 1 for a comma
            yield pa.RecordBatch.from_arrays([short if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    sized = rows.withColumn("cost", F.when(F.col("record").isNotNull(), cost).otherwise(0))
    long = rows.where(cost > limit).mapInArrow(cut, rows.schema).withColumn("cost", cost)
    return sized.where(F.col("cost") <= limit).unionByName(long)


def _reduced(df: DataFrame, keys: list[str], task: str, fields: list[Field], judge: Judge, budget: int) -> tuple[DataFrame, list[str]]:
    """One answer for each key, by packs of records whose prompts have at most `budget` tokens, and packs of the packs' answers.

    The result has the keys as k0, k1 and so on (the list), the fields as v0, v1 and so on, and
    `error`. What fits one prompt is one pack. Else records of a size are dealt by the running sum of their characters
    in the order of their hashes: what begins within a stretch of 1 - 1/n of the room is a pack, as the last of them takes at most 1/n.
    So a pack never exceeds the room, equal records are spread, and a pack is the same however often it is computed. A record
    over the room is cut by likeness to the task, and so is a pack's answer over a quarter of it (of a very small room, over just
    less than half), so that each round leaves a third of the packs or so. A pack that stays unanswered
    makes all fields of its key null, as the rest would be an answer about a part of the
    rows. Without keys there is one answer, even of no rows.
    """
    own = [f"k{i}" for i in range(len(keys))]
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])) if len(df.columns) > len(keys) else F.lit("{}")
    rows = df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], record.alias("record"), F.lit(None).cast("string").alias("lost"))
    prompt = _task(task, fields)
    budget = min(budget, judge.context or budget)
    free = room(budget, prompt, _EMPTY)
    line = len(retried(prompt, parse_json)) - len(prompt)  # of a prompt that is asked again
    free = limit = free - line if line < free // 8 else free
    while True:
        counted = _fitted(rows, prompt, judge, limit).groupBy(*own, "record", "cost").agg(F.count(F.lit(1)).alias("n"), F.max("lost").alias("lost"))
        share = F.coalesce(*[F.when(F.col("cost") * x > free, x // 2) for x in _SIZES], F.lit(_SIZES[-1]))  # the record takes at most 1 / share
        counted = counted.withColumns({"share": share, "one": F.xxhash64("record"), "two": F.xxhash64(F.lit(1), "record")})
        order = F.struct(*own, "share", "one", "two").alias("order")
        dealt = running(counted.select("*", order, (F.col("n") * F.col("cost")).alias("all")), "order", "all")
        kinds = dealt.groupBy(*[F.col(k).alias(f"_{k}") for k in own], F.col("share").alias("_share")).agg(F.min("before").alias("base"), F.sum("all").alias("all"))
        whole = kinds.groupBy(*[F.col(f"_{k}").alias(f"__{k}") for k in own]).agg(F.sum("all").alias("whole"))
        most = whole.agg(F.max("whole")).first()[0] or 0
        same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in own]
        kinds = kinds.join(whole, same("_", "__")) if own else kinds.join(F.broadcast(whole))  # one row
        of = dealt.drop("all", "order").join(kinds.select(*[f"_{k}" for k in own], "_share", "base", "whole"), [*same("", "_"), F.col("share") == F.col("_share")])
        # copies begin at before, before + cost, ...; stretches of `wide` characters
        alone, cost, n = F.col("share") == 1, F.col("cost"), F.col("n")
        wide = F.when(F.col("whole") <= free, F.lit(1 << 62)).when(alone, F.greatest(cost, F.lit(1))).otherwise(F.floor(F.lit(free) - F.lit(free) / F.col("share"))).cast("long")
        begin = F.when(alone & (F.col("whole") > free), F.lit(0).cast("long")).otherwise(F.col("before") - F.col("base"))
        packed = of.withColumns({"wide": wide, "begin": begin}).withColumn("last", F.col("begin") + cost * (n - 1))
        packed = packed.withColumn("pack", F.explode(F.sequence(F.floor(F.col("begin") / F.col("wide")), F.floor(F.col("last") / F.col("wide")))))
        before = lambda at: F.when(cost == 0, F.when(at > F.col("begin"), n).otherwise(0)).otherwise(
            F.least(n, F.greatest(F.lit(0), F.ceil((at - F.col("begin")) / cost)))
        )
        end = F.when(F.col("wide") == 1 << 62, n).otherwise(before((F.col("pack") + 1) * F.col("wide")))
        copies = (end - F.when(F.col("wide") == 1 << 62, 0).otherwise(before(F.col("pack") * F.col("wide")))).cast("int")
        named = F.when(F.col("whole") <= free, F.lit("")).when(alone, F.concat_ws(" ", "share", "pack", "one", "two")).otherwise(F.concat_ws(" ", "share", "pack"))
        packed = packed.select(*own, named.alias("pack"), "lost", F.when(F.col("record").isNotNull(), F.array_repeat("record", copies)).alias("some"))
        packs = packed.groupBy(*own, "pack").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("some"), F.max("lost").alias("lost"))
        if not own:
            packs = df.sparkSession.range(1).select().join(packs, how="left")
        packs = packs.withColumn("records", F.to_json(F.coalesce("some", F.array().cast("array<string>")))).drop("some")
        asked, reply, error = judge.ask(packs, prompt, ["records"], parse_json, context=budget)
        lost = F.coalesce("lost", F.col(error))
        if most <= free:
            given = [F.when(lost.isNull(), value).alias(f"v{i}") for i, value in enumerate(_given(reply, fields).values())]
            return asked.select(*own, *given, lost.alias("error")), own
        rows, limit = asked.select(*own, F.col(reply).alias("record"), lost.alias("lost")), max(free // 4, min(LEAST, free // 2 - 1))


def sem_aggregate(df: DataFrame, task: str, fields: list[Field], judge: Judge, *, budget: int = 8000, errors: str | None = None) -> DataFrame:
    """One row with the fields: a rule gives the aggregates; else a model reads the records in packs, and the packs' answers.

    There is one row of an empty table too. If any pack stays unanswered all fields are null,
    and the column that `errors` names says why.
    """
    native = judge.rule(task, df)
    if native is not None:
        found = df.agg(*[native[f.name].alias(f.name) for f in fields])
        return found.withColumn(errors, F.lit(None).cast("string")) if errors else found
    found, _ = _reduced(df, [], task, fields, judge, budget)
    return found.select(*[F.col(f"v{i}").alias(f.name) for i, f in enumerate(fields)], *([F.col("error").alias(errors)] if errors else []))


def sem_groupby(
    df: DataFrame, keys: list[Field], aggregates: list[tuple[str, str, str]] | list[tuple[str, str]], judge: Judge, *, budget: int = 8000, errors: str | None = None
) -> DataFrame:
    """One row for each key. Keys that are no columns are computed as by sem_map; null is a key.

    aggregates are (column, function, alias, type), alias being the column by default; of two
    with one alias the later wins. The type is that of a model's answer, string by default. Functions that are not built in are tasks for the model,
    one pack of a group at a time; `errors` names a column for what went wrong with these.
    """
    made = [k for k in keys if k.name not in df.columns]
    df = sem_map(df, made, judge) if made else df
    names = [k.name for k in keys]
    wanted = {x[2] if len(x) > 2 else x[0]: x for x in aggregates}
    native: dict[str, Column] = {alias: AGGREGATES[x[1]](x[0]) for alias, x in wanted.items() if x[1] in AGGREGATES}
    found = df.groupBy(*names).agg(*[c.alias(alias) for alias, c in native.items()]) if native else df.select(*names).distinct()
    failed = []
    for i, (alias, x) in enumerate(wanted.items()):
        if alias not in native:
            rows = df.select(*names, *[c for c in [x[0]] if c in df.columns and c not in names])
            more, own = _reduced(rows, names, x[1], [Field(alias, x[3] if len(x) > 3 else "string")], judge, budget)
            marks = fresh(found, *[f"_{k}" for k in own], "_error")
            more = more.select(*[F.col(k).alias(m) for k, m in zip(own, marks, strict=False)], F.col("v0").alias(alias), F.col("error").alias(f"_error{i}_"))
            found = found.join(more, [F.col(f"`{k}`").eqNullSafe(F.col(m)) for k, m in zip(names, marks, strict=False)]).drop(*marks)
            failed.append(F.col(f"_error{i}_"))
    wrong = F.coalesce(*failed) if failed else F.lit(None).cast("string")
    return found.select(*names, *wanted, *([wrong.alias(errors)] if errors else []))
