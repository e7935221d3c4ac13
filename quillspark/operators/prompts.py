"""Prompt families, their filling, and the lines appended to them.

A family is an opening plus numbered items. The item about keywords depends on the case:
both lists ("both"), only include ("in") or neither ("none"). Texts are known when the
plan is built, so a filled prompt is one concat expression per case and no join at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import fixed as fx
from quillspark.functions.text import concept as tidy_concept

CASES = ("both", "in", "none")
KINDS = ("abs", "solo")


@dataclass(frozen=True)
class Family:
    unit: str
    items: list[str]
    openings: dict[str, str]
    solo_items: list[str] | None = None
    changes: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def item_count(self, case: str, kind: str) -> int:
        items = self.solo_items if kind == "solo" and self.solo_items else self.items
        return len(items) + (0 if case == "none" else 1)

    def text(self, case: str, kind: str) -> str:
        items = self.solo_items if kind == "solo" and self.solo_items else self.items
        lead = {"both": [fx.KEYWORDS_BOTH], "in": [fx.KEYWORDS_IN], "none": []}[case]
        lines = [f"{n}. {line}" for n, line in enumerate(lead + items, 1)]
        out = "\n".join([self.openings[kind], *lines]).replace("{unit}", self.unit)
        old, new = self.changes.get((case, kind), ("", ""))
        return out.replace(old, new) if old else out


_BRIEF = {"abs": f"{fx.BRIEF_ABS}\n{fx.DOCUMENT_ALSO}", "solo": fx.BRIEF_SOLO}
_PLAIN = {
    "abs": f"Write sentences corresponding to the following abstract description: $abs$.\n{fx.SENTENCE_ALSO}",
    "solo": "Write sentences with the following constraints:",
}
_START = {
    "abs": f"Write {{start}} corresponding to the following abstract description: $abs$.\n{fx.SENTENCE_ALSO}",
    "solo": "Write {num_sent} {start} with the following constraints:",
}
_SPELLED = {**_BRIEF, "abs": _BRIEF["abs"].replace("contraints", "constraints")}
_LOOSE_ENTITIES = {("none", "solo"): ("1. {ner_labels}.", "1. {ner_labels}. ")}

FAMILIES: dict[str, Family] = {
    "concepts": Family("document", [fx.TOPIC_LINE, fx.LENGTH_LINE], _SPELLED),
    "exemplars_plain": Family("document", [fx.TOPIC_LINE, fx.LENGTH_LINE], _BRIEF),
    "exemplars": Family("sentences", [fx.TOPIC_PAIR_SENTENCES_LINE, fx.LENGTH_LINE], _PLAIN),
    "exemplars_pos": Family("document", [fx.TOPIC_LINE, fx.POS_LINE, fx.LENGTH_LINE], _BRIEF),
    "cross": Family("document", [fx.TOPIC_PAIR_LINE, fx.LENGTH_LINE], _BRIEF),
    "pos": Family(
        "{start}", [fx.POS_LINE, fx.LENGTH_LINE], _START,
        solo_items=[fx.POS_LINE, fx.TOPIC_START_LINE, fx.LENGTH_LINE],
        # upstream numbers two lines "2." here
        changes={("none", "solo"): ("3. The {start} should have a length", "2. The {start} should have a length")},
    ),
    "pair": Family("{start}", [fx.POS_LINE, fx.LENGTH_LINE, fx.SIMILAR_LINE], _START),
    "ner": Family("document", [fx.ENTITIES_LINE, fx.EXAMPLES_LINE, fx.LENGTH_LINE], _BRIEF, changes=_LOOSE_ENTITIES),
    "ner_pos": Family(
        "document", [fx.ENTITIES_LINE, fx.EXAMPLES_LINE, fx.POS_LINE, fx.LENGTH_LINE], _BRIEF,
        changes=_LOOSE_ENTITIES,
    ),
    "ner_exemplars": Family("document", [fx.TOPIC_PAIR_LINE, fx.LENGTH_LINE], _BRIEF),
    "ner_exemplars_pos": Family(
        "document", [fx.TOPIC_PAIR_LINE, fx.POS_LINE, fx.LENGTH_LINE], _BRIEF,
        changes={("both", "abs"): ("3. The document should", "3. The documentshould")},
    ),
    "qa": Family("document", [fx.QUESTION_LINE], {"solo": fx.QA_SOLO, "abs": fx.QA_SOLO}),
}


def fill(template: str, values: dict[str, Column]) -> Column:
    """Fill {slots} in one pass: a value that looks like a slot is left alone."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        slot = piece[1:-1] if piece.startswith("{") and piece.endswith("}") else None
        if slot in values:
            parts.append(F.coalesce(values[slot].cast("string"), F.lit("")))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def asks_for(family: str, slot: str) -> bool:
    """Whether a prompt of the family has the slot."""
    fam = FAMILIES[family]
    return any(f"{{{slot}}}" in fam.text(c, kind) for c in CASES for kind in KINDS if kind in fam.openings)


def choose(inc: Column, exc: Column, by_case: dict[str, Column]) -> Column:
    has_inc, has_exc = F.length(inc) > 0, F.length(exc) > 0
    return (
        F.when(has_inc & has_exc, by_case["both"]).when(has_inc, by_case["in"]).otherwise(by_case["none"])
    )


def render(family: str, kind: str, values: dict[str, Column], inc: Column, exc: Column) -> Column:
    """The filled prompt of a row."""
    fam = FAMILIES[family]
    values = {**values, "inc_kws": inc, "exc_kws": exc}
    return choose(inc, exc, {c: fill(fam.text(c, kind), values) for c in CASES})


def concept_start(family: str, kind: str, inc: Column, exc: Column, thresholds=None) -> Column:
    """First number of the appended concept lines: items + 1.

    ``thresholds`` (for example (4, 3, 1)) gives upstream's rule instead: the template is
    searched for "3." and then "2." (for (5, 4, 3): "4." and "3.").
    """
    fam = FAMILIES[family]
    if thresholds is None:
        return choose(inc, exc, {c: F.lit(fam.item_count(c, kind) + 1) for c in CASES})
    hi, mid, low = thresholds

    def found(text: str) -> int:
        return hi if f"{hi - 1}." in text else mid if f"{mid - 1}." in text else low

    return choose(inc, exc, {c: F.lit(found(fam.text(c, kind))) for c in CASES})


def append_concepts(prompt: Column, concepts: Column, start: Column) -> Column:
    """One numbered line per concept sentence."""
    lines = F.transform(
        concepts, lambda c, i: F.concat(F.lit("\n"), (start + i).cast("string"), F.lit(". "), c)
    )
    return F.concat(prompt, F.array_join(F.coalesce(lines, F.array().cast("array<string>")), ""))


def concept_sentences(
    predictions: DataFrame, label: str, order: str, predict: str,
    subject: str = "Any sentence in the document",
) -> DataFrame:
    """(label, order, sentence): one sentence per generated concept, in long form."""
    return predictions.select(
        F.col(label).alias("label"),
        F.col(order).alias("ord"),
        F.concat(F.lit(subject + fx.NO_CONCEPT), tidy_concept(F.col(predict)), F.lit(".")).alias("sentence"),
    )


def concept_lists(sentences: DataFrame) -> DataFrame:
    """(label, concepts): all sentences of a label in order. The concept step asks for a few
    per label, so the lists are short."""
    listed = F.sort_array(F.collect_list(F.struct("ord", "sentence")))
    return sentences.groupBy("label").agg(F.transform(listed, lambda s: s["sentence"]).alias("concepts"))


def topic_sentence(dataset: str, label: Column) -> Column:
    return fill(fx.TOPIC_SENTENCES[dataset], {"label": label})


def abstract_request(text: Column, unit: str = "document") -> Column:
    return F.concat(F.lit(fx.ABSTRACT_REQUEST.replace("{unit}", unit)), text)
