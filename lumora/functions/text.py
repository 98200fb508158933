"""Token counts, chunks and fitting texts into a budget, as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that count as one token where no tokenizer is named.
CHARS = 4


def count_tokens(text: Column) -> Column:
    """A quarter of the characters and one; null is null."""
    return (F.floor(F.length(text) / CHARS) + 1).cast("long")


def chunk_size(tokens: Column, budget: int, join: bool = False) -> Column:
    """Tokens of a chunk of an input of so many tokens: a 32nd of it or a tenth of the budget, one at least, half for joins."""
    size = F.greatest(F.lit(1), F.least(F.floor(tokens / 32), F.lit(budget // 10)))
    return (F.greatest(F.lit(1), F.floor(size / 2)) if join else size).cast("long")


def chunks(text: Column, chars: int | Column) -> Column:
    """The text in pieces of so many characters that do not overlap; empty and null give no pieces."""
    size = F.lit(chars) if isinstance(chars, int) else chars
    last = F.floor((F.length(text) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size.cast("int") + 1, size.cast("int")))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def chunked(df: DataFrame, text_col: str, chars: int, *, position: str = "position", chunk: str = "chunk") -> DataFrame:
    """One row for each chunk of each row's text, with the row's other columns."""
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(chunks(F.col(text_col), chars)).alias(position, chunk))


def ranked(df: DataFrame, id_col: str, similarity: str, position: str = "position") -> DataFrame:
    """Chunks with `rank` within their id: the most similar first, ties by position."""
    order = Window.partitionBy(id_col).orderBy(F.col(similarity).desc(), position)
    return df.withColumn("rank", F.row_number().over(order))


def fitted(
    df: DataFrame, id_col: str, budget: int | str, *, chunk: str = "chunk", rank: str = "rank", position: str = "position", text: str = "text"
) -> DataFrame:
    """id, text: each id's chunks in falling rank while their tokens fit the budget, in their first order, joined by "...".

    The first chunk stays even if it alone is over the budget. A text whose chunks all fit
    is returned whole, without the dots.
    """
    most = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    by_rank = Window.partitionBy(id_col).orderBy(rank)
    used = df.withColumn("_used", F.sum(count_tokens(F.col(chunk))).over(by_rank)).withColumn("_fits", (F.col("_used") <= most) | (F.col(rank) == 1))
    parts = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(F.col(position).alias("p"), F.col(chunk).alias("c"))))), lambda x: x["c"]
    )
    return used.groupBy(id_col).agg(
        F.when(F.bool_and("_fits"), F.array_join(parts, "")).otherwise(F.array_join(parts, "...")).alias(text)
    )


def _prefix(pieces: Column, budget: Column, text: str) -> Column:
    """How many of the pieces fit the budget one after the other; the first always does."""
    used = F.aggregate(
        pieces, F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            (a["used"] + count_tokens(x[text])).alias("used"),
            (a["n"] + F.when((a["used"] == 0) | (a["used"] + count_tokens(x[text]) <= budget), 1).otherwise(0)).alias("n"),
        ),
    )
    return used["n"]


def _turn(field: int):
    """A field's ranked chunk with its place among all fields' chunks: the rank, then the field."""
    return lambda x, r: F.struct(r.alias("r"), F.lit(field).alias("j"), x["i"].alias("i"), x["c"].alias("c"))


def fit_record(df: DataFrame, fields: list[str], budget: int | str, *, chars: int = 400, score=None) -> DataFrame:
    """df with its text fields cut so that together they fit the budget (tokens, or a column of them).

    A record within its budget stays as it is. Else each field's chunks of `chars` characters
    are ranked by score(chunk), the most similar first (by position where there is no score);
    the fields take turns, best chunks first, until the budget is spent, and each field is
    its chunks in their first order, joined by "...". The first chunk of the first field stays even if
    it alone is over the budget; a field that got none is empty, a null one null. All is
    done within the row: nothing is shuffled.
    """
    most = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    score = score or (lambda c: F.lit(0.0))
    total = sum((F.coalesce(count_tokens(F.col(f)), F.lit(0)) for f in fields), F.lit(0))
    ranked = []
    for j, f in enumerate(fields):
        pieces = F.transform(chunks(F.col(f), chars), lambda c, i: F.struct((-score(c)).cast("double").alias("s"), i.alias("i"), c.alias("c")))
        ranked.append(F.transform(F.array_sort(pieces), _turn(j)))
    turns = F.array_sort(F.concat(*ranked) if len(ranked) > 1 else ranked[0])
    fit = df.withColumn("_turns", turns).withColumn("_turns", F.slice("_turns", F.lit(1), _prefix(F.col("_turns"), most, "c")))

    def joined(f: str, j: int) -> Column:
        own = F.array_sort(F.transform(F.filter("_turns", lambda x: x["j"] == j), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c"))))
        return F.when((total <= most) | F.col(f).isNull(), F.col(f)).otherwise(F.array_join(F.transform(own, lambda x: x["c"]), "..."))

    return fit.withColumns({f: joined(f, j) for j, f in enumerate(fields)}).drop("_turns")


def fit_text(df: DataFrame, text_col: str, budget: int | str, *, chars: int = 400, score=None) -> DataFrame:
    """fit_record() of one field, but a text whose chunks all fit is whole, whatever its own tokens; null and empty texts stay."""
    most = F.lit(budget) if isinstance(budget, int) else F.col(budget)
    score = score or (lambda c: F.lit(0.0))
    cut = chunks(F.col(text_col), chars)
    ranked = F.array_sort(F.transform(cut, lambda c, i: F.struct((-score(c)).cast("double").alias("s"), i.alias("i"), c.alias("c"))))
    rows = df.withColumn("_ranked", ranked).withColumn("_n", _prefix(F.col("_ranked"), most, "c"))
    own = F.array_sort(F.transform(F.slice("_ranked", F.lit(1), F.col("_n")), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c"))))
    whole = F.col(text_col).isNull() | (F.col("_n") == F.size("_ranked"))
    return rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(F.array_join(F.transform(own, lambda x: x["c"]), "..."))).drop("_ranked", "_n")


def chunk_record(df: DataFrame, fields: list[str], chars: int) -> DataFrame:
    """df with each text field as an array of its chunks; the other columns stay."""
    return df.withColumns({f: chunks(F.col(f), chars) for f in fields})


def fit_join(left: DataFrame, right: DataFrame, left_fields: list[str], right_fields: list[str], budget: int, **options) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, each record within half of the budget that a pair has."""
    return fit_record(left, left_fields, budget // 2, **options), fit_record(right, right_fields, budget // 2, **options)


def fit_aggregate(df: DataFrame, fields: list[str], budget: int, **options) -> DataFrame:
    """The records of an aggregate, each within its share of the budget, in proportion to its tokens; all whole if they fit together."""
    tokens = sum((F.coalesce(count_tokens(F.col(f)), F.lit(0)) for f in fields), F.lit(0))
    shared = budget_share(df.withColumn("_tokens", tokens), "_tokens", budget, share="_share", total="_all")
    shared = shared.withColumn("_share", F.when(F.col("_all") <= budget, F.col("_tokens")).otherwise(F.col("_share")))
    return fit_record(shared, fields, "_share", **options).drop("_tokens", "_share", "_all")


def budget_share(df: DataFrame, tokens: str, budget: int, *, share: str = "share", total: str | None = None) -> DataFrame:
    """Each row's part of a budget in proportion to its tokens, rounded down; nothing if there are none. `total` names a column for the sum."""
    whole = df.agg(F.sum(tokens).alias("_total"))
    found = df.join(F.broadcast(whole)).withColumn(  # the sum is one row
        share, F.coalesce(F.floor(F.col(tokens) * budget / F.nullif("_total", F.lit(0))), F.lit(0)).cast("long")
    )
    return found.withColumnRenamed("_total", total) if total else found.drop("_total")
