"""A DataFrame with semantic operators to chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lumora.operators import relational, semantic, topk
from lumora.operators.index import TextIndex
from lumora.plans.judges import Field, Judge


class SemFrame:
    """Each step gives a new frame over a DataFrame. Rules and relational steps are lazy, but a join counts its keys when it is called; a step that asks a model runs its jobs then."""

    def __init__(self, df: DataFrame, judge: Judge | None = None):
        self.df, self.judge = df, judge or Judge()

    def _next(self, df: DataFrame) -> SemFrame:
        return SemFrame(df, self.judge)

    def sem_filter(self, condition: str, **options) -> SemFrame:
        return self._next(semantic.sem_filter(self.df, condition, self.judge, **options))

    def sem_map(self, fields: list[Field], **options) -> SemFrame:
        return self._next(semantic.sem_map(self.df, fields, self.judge, **options))

    def sem_flat_map(self, fields: list[Field], task: str, **options) -> SemFrame:
        return self._next(semantic.sem_flat_map(self.df, fields, self.judge, task, **options))

    def sem_join(self, other: SemFrame, condition: str, **options) -> SemFrame:
        return self._next(semantic.sem_join(self.df, other.df, condition, self.judge, **options))

    def sem_aggregate(self, task: str, fields: list[Field], **options) -> SemFrame:
        return self._next(semantic.sem_aggregate(self.df, task, fields, self.judge, **options))

    def sem_groupby(self, keys: list[Field], aggregates: list[tuple], **options) -> SemFrame:
        return self._next(semantic.sem_groupby(self.df, keys, aggregates, self.judge, **options))

    def sem_topk(self, query: list[float], k: int, **options) -> SemFrame:
        return self._next(topk.sem_topk(self.df, query, k, **options))

    def sem_search(self, index: TextIndex, query: str, k: int, **options) -> SemFrame:
        """The rows of an index over texts that are nearest to a query's text."""
        return self._next(index.search(query, k, **options))

    def sem_rank(self, task: str, k: int, **options) -> SemFrame:
        """The k best rows (scored candidates, as of a search) by a model that ranks lists of them."""
        return self._next(topk.judged_topk(self.df, task, k, self.judge, **options))

    def limit(self, n: int) -> SemFrame:
        return self._next(self.df.limit(n))

    def code(self, change: Callable[[DataFrame], DataFrame] | str) -> SemFrame:
        """A function of the DataFrame, or SQL over it as {rows}; either gives rows."""
        if callable(change):
            return self._next(change(self.df))
        return self._next(self.df.sparkSession.sql(change, rows=self.df))

    def union(self, *others: SemFrame) -> SemFrame:
        return self._next(relational.union_ragged([self.df, *[o.df for o in others]]))

    def sample(self, id_col: str, n: int, seed: int = 7) -> SemFrame:
        return self._next(relational.sample_fixed(self.df, id_col, n, seed))

    def reason(self, template: str, *columns: str) -> tuple[DataFrame, str]:
        """The last step: the rows, and an answer of the first one by a template of its columns."""
        rows = self.df.select(*columns) if columns else self.df
        first = rows.first()
        return rows, template.format(**first.asDict()) if first else ""
