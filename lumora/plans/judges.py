"""A judge answers instructions: by rules, which are native columns, or by asking a model in batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.plans.fitting import Fitter, room
from lumora.tables import sliced, written

#: Characters of an unusable reply that the next prompt quotes.
QUOTED = 120


class Unanswered(ValueError):
    """Neither a rule nor a model can answer an instruction."""


@dataclass(frozen=True)
class Field:
    """An output field: its name, Spark type and description."""

    name: str
    type: str = "string"
    description: str = ""


@dataclass(frozen=True)
class Pairs:
    """A pair condition: equal columns of left and right, and what must hold besides."""

    equal: tuple[tuple[str, str], ...]
    residual: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None


@dataclass
class Judge:
    """rules: native meanings by instruction (a function of the DataFrame). model: prompts to replies, batch by batch.

    A rule stands in for a judgement; it is no evidence of a model's quality. Replies that could
    be parsed are written once and kept for this judge, by a hash of their prompt, until forget().

    No prompt has more than `context` tokens (a quarter of its characters and one): a longer record
    is cut as Fitter has it, by the likeness of its chunks to the task where `embed` gives vectors.
    """

    rules: dict[str, Callable] = field(default_factory=dict)
    model: Callable[[list[str]], list[str]] | None = None
    attempts: int = 3
    fail_fast: bool = False
    batch: int = 64
    context: int | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    _known: dict[str, list[DataFrame]] = field(default_factory=dict, repr=False, compare=False)

    def forget(self) -> None:
        """Ask anew from now on."""
        self._known.clear()

    def rule(self, instruction: str, *args):
        made = self.rules.get(instruction)
        return made(*args) if made else None

    def ask(
        self, df: DataFrame, task: str, columns: list[str], parse: Callable[[str], str | None], *, sides: tuple[tuple[str, ...], ...] = (), context: int | None = None
    ) -> tuple[DataFrame, str, str]:
        """df with two more columns, and their names: what parse() gives of the reply, and an error; null where there is none.

        Asks when it is called, and only what this judge has no answer to: distinct
        prompts, told apart by 128 bits of hashes, go to the model once; their replies are
        written, so that no later step or retry of one asks again. What cannot be parsed is
        asked again with the reason and the reply in the task's line (unless that alone would make a record
        too long), `attempts` times in all; then the reply is null and the error says so, or the job fails if fail_fast. Later calls ask such
        prompts anew. A null record (all columns null) is asked like any other.
        """
        if self.model is None:
            raise Unanswered(f"no rule and no model for: {task}")
        one, two, reply, error = fresh(df, "_one", "_two", "_reply", "_error")
        prompt = F.concat(F.lit(f"{task}\n"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
        kind = F.lit(f"{parse.__name__} {context or self.context} {sides}")
        marks = {one: F.xxhash64(kind, prompt), two: F.xxhash64(prompt, kind)}
        answers, size = self.answerer(task, parse, sides, context), self.batch

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, size, 1 << 62):  # the model's own batches
                replies, errors = answers(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["one", "two", "reply", "error"]
                )

        known = self._known.setdefault(df.sparkSession.sparkContext.applicationId, [])
        prompts = df.select(marks[one].alias("one"), marks[two].alias("two"), prompt.alias("prompt")).groupBy("one", "two").agg(F.min("prompt").alias("prompt"))
        for earlier in known:
            prompts = prompts.join(earlier, ["one", "two"], "left_anti")
        asked = written(prompts.mapInArrow(answer, "one long, two long, reply string, error string"), "replies")
        answers = reduce(DataFrame.unionByName, [*known, asked]).select(
            F.col("one").alias(one), F.col("two").alias(two), F.col("reply").alias(reply), F.col("error").alias(error)
        )
        known.append(asked.where("error is null"))
        if len(known) > 8:
            known[:] = [written(reduce(DataFrame.unionByName, known), "replies")]
        return df.withColumns(marks).join(answers, [one, two]).drop(one, two), reply, error

    def answerer(
        self, task: str, parse: Callable[[str], str | None], sides: tuple[tuple[str, ...], ...] = (), context: int | None = None
    ) -> Callable[[list[str]], tuple[list[str | None], list[str | None]]]:
        """A function of prompts (the task's line, then a record) that runs in tasks: what parse() gives of their replies, and errors."""
        model, attempts, fail_fast, size, context = self.model, self.attempts, self.fail_fast, self.batch, context or self.context
        expects = EXPECTS.get(parse.__name__, "what was asked for")
        if context is not None:
            room(context, task, " ")  # an error now rather than in a task
        fitter = Fitter(task, self.embed, sides, batch=size)

        def shown(prompt: str, reply: str | None = None) -> str:
            """The prompt, within the context, after an unusable reply if there was one."""
            head, record = task if reply is None else retried(task, parse, reply), prompt[len(task) + 1 :]
            if context is not None and len(record) > room(context, head, " ") and len(record) <= room(context, task, " "):
                head = task
            return f"{head}\n{record if context is None else fitter.fit(record, room(context, head, ' '))}"

        def answers(prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
            replies: list[str | None] = [None] * len(prompts)
            for at in range(0, len(prompts), size):
                open_ = list(range(at, min(at + size, len(prompts))))
                sent = {i: shown(prompts[i]) for i in open_}
                for _ in range(attempts):
                    for i, text in zip(open_, model([sent[i] for i in open_]), strict=True):
                        replies[i] = parse(text)
                        if replies[i] is None:
                            sent[i] = shown(prompts[i], text or "")
                    open_ = [i for i in open_ if replies[i] is None]
                    if not open_:
                        break
                if open_ and fail_fast:
                    raise ValueError(f"no reply to be parsed as {expects} after {attempts} attempts: {prompts[open_[0]][:200]}")
            return replies, [None if x is not None else f"no reply to be parsed as {expects} after {attempts} attempts" for x in replies]

        return answers


#: What a parser takes, as told to the model.
EXPECTS = {"parse_boolean": "either true or false", "parse_json": "a JSON object or array", "parse_ranking": "a JSON list of places"}


def retried(task: str, parse: Callable, reply: str = "." * QUOTED) -> str:
    """The line of a task after a reply that could not be parsed; it is the longest by default."""
    return f"{task} (Your last reply was not {EXPECTS.get(parse.__name__, 'what was asked for')}. It was: {' '.join(reply[:QUOTED].split())})"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores in front of those that are columns of df."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def parse_boolean(text: str) -> str | None:
    """true or false, whichever the reply names in any case; neither or both are no answer."""
    low = (text or "").lower()
    yes, no = "true" in low, "false" in low
    return None if yes == no else str(yes).lower()


def parse_json(text: str) -> str | None:
    """The outermost JSON object or array of a reply, as text."""
    text = text or ""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    end = max(text.rfind("}"), text.rfind("]"))
    if not starts or end < min(starts):
        return None
    try:
        json.loads(text[min(starts) : end + 1])
    except ValueError:
        return None
    return text[min(starts) : end + 1]
