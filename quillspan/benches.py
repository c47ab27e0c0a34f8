"""What belongs to one benchmark: where its items are, how answers are generated, asked for and scored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan import schemas
from quillspan.functions import text as T
from quillspan.operators.scorecard import ANSWERED, CORRECT


@dataclass(frozen=True)
class Bench:
    """``templates`` by language have {question} and, with options, {options}; ``generation`` goes into the request as it is."""

    name: str
    schema: str
    templates: dict[str, str]
    generation: dict = field(default_factory=dict)
    correct: Callable[[Column, Column], Column] | None = None
    answered: Callable[[Column], Column] | None = None

    def prompt(self, lang: Column, question: Column, options: Column | None = None) -> Column:
        template = T.localised(lang, self.templates)
        return T.choice_prompt(question, options, template) if options is not None else F.replace(template, F.lit("{question}"), question)


BENCHES: dict[str, Bench] = {}


def register(bench: Bench) -> Bench:
    """Add a benchmark; its rules of scoring join the registries of ``operators.scorecard``."""
    BENCHES[bench.name] = bench
    if bench.correct:
        CORRECT[bench.name] = bench.correct
    if bench.answered:
        ANSWERED[bench.name] = bench.answered
    return bench


def check_arguments(bench: str, langs: list[str], items: int | None = None, limit: int | None = None, repeat: int | None = None, ids: list[int] | None = None, known_ids: set[int] | None = None) -> None:
    """An error that says what is wrong with the arguments of a run, before anything is asked."""
    if bench not in BENCHES:
        raise ValueError(f"unknown benchmark {bench}; known: {', '.join(sorted(BENCHES))}")
    if not langs or set(langs) - set(BENCHES[bench].templates) or len(set(langs)) < len(langs):
        raise ValueError(f"languages must be a non-empty subset of {', '.join(BENCHES[bench].templates)}")
    if limit is not None and (limit < 1 or items is not None and limit > items):
        raise ValueError(f"the limit must be between 1 and the number of items ({items})")
    if repeat is not None and repeat < 1:
        raise ValueError("a repeat is at least 1")
    if ids is not None and known_ids is not None and (lost := sorted(set(ids) - known_ids)):
        raise ValueError(f"no item has the ids {lost}")


_LETTER = {"en": "{question}\n\n{options}\n\nAnswer:", "es": "{question}\n\n{options}\n\nRespuesta:", "zh": "{question}\n\n{options}\n\n答案："}
register(Bench("mgsm", schemas.ITEM_NUMBER, {"en": "{question}", "es": "{question}", "zh": "{question}"}))
register(Bench("belebele", schemas.ITEM_CHOICE, _LETTER))
register(Bench("proxlite", schemas.ITEM_CHOICE, _LETTER))
