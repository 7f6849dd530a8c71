"""Licence scans: texts against licence templates by Dice over word bigrams.

One projection of built-in functions: no Python on executors, no shuffle, no join.
Templates are whole licence texts, their paragraphs, headers and short notices. A unit
(line, paragraph or whole text) can only reach ``least`` against a template if

- their numbers of bigrams differ by no more than least/(2-least), and
- it has one of any ``m - o + 1`` of the template's bigrams, m being how many the
  template has and o the fewest that both must share (prefix filter), and so one of
  the words that these bigrams are chosen by.

The second rule prunes texts before they are cut into units, the first one templates.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm import license_texts as fixed

LEAST = 0.8
#: Paragraphs of so many bigrams are templates of their own.
PARAGRAPH = 12

#: Words that any text may hold; others, and of these longer ones, count as rarer.
COMMON = {*"0 1 2 3 4 a and any by contents damages details file for form in is of or other possible program project public related source subject that the this to under version work you your".split()}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]|_", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def known_templates() -> dict[str, list[str]]:
    """Licence id to texts: whole ones, paragraphs, headers, notices.

    A paragraph that several licences share stands under their ids, joined by " OR ".
    """
    found: dict[tuple[str, ...], tuple[str, set[str]]] = {}

    def add(name: str, text: str) -> None:
        if key := tuple(sorted(bigrams_of(text))):
            found.setdefault(key, (text.strip(), set()))[1].add(name)

    for name, text in [*fixed.TEXTS.items(), *((n, t) for n, ts in fixed.HEADERS.items() for t in ts)]:
        add(name, text)
        for paragraph in re.split(r"\n\s*\n", text):
            if len(bigrams_of(paragraph)) >= PARAGRAPH:
                add(name, paragraph)
    for name, names in fixed.NAMES.items():
        for n in names:
            for notice in fixed.NOTICES:
                add(name, notice.format(n))
    for name, sentences in fixed.SENTENCES.items():
        for sentence in sentences:
            add(name, sentence)
    out: dict[str, list[str]] = {}
    for text, names in found.values():
        out.setdefault(" OR ".join(sorted(names)), []).append(text)
    return out


TEMPLATES = known_templates()


def fewest_shared(m: int, least: float) -> int:
    """Bigrams that a unit shares at least with a template of ``m`` if it reaches ``least``."""
    smallest = math.ceil(round(least * m / (2 - least), 9))
    return math.ceil(round(least * (m + smallest) / 2, 9))


def needles_of(bigrams: list[str], least: float) -> set[str]:
    """Words of which a unit must have one to reach ``least``: the rarer of each of the m - o + 1 bigrams with the rarest."""

    def common(word: str) -> tuple[bool, int, str]:
        return word in COMMON, -len(word), word

    rarest = sorted((min(b.split(), key=common) for b in bigrams), key=common)
    return {*rarest[: max(1, len(bigrams) - fewest_shared(len(bigrams), least) + 1)]}


def _template_array(templates: dict[str, list[str]]) -> Column:
    rows = [{"id": name, "size": len(b), "bigrams": b} for name in sorted(templates) for t in templates[name] if (b := bigrams_of(t))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<id:string,size:int,bigrams:array<string>>>")  # a constant: folded once


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license_id, dice, unit, n_licenses: one row a document.

    Of the matches of all units and templates, the one with the most bigrams in common
    (the whole text of a licence tells more than one of its clauses), then the highest
    Dice, the smallest id, the smallest unit. Where nothing reaches ``least``,
    license_id, dice and unit are null and n_licenses is 0. ``n_licenses`` counts the
    template ids that any unit matches. Text is compared in lower case, as runs of
    letters and digits. A null or empty text matches nothing; repeated rows and null
    ids are scanned like any others; other columns are ignored. A template of one word
    has no bigrams and is ignored.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    templates = TEMPLATES if templates is None else templates
    sets = [b for ts in templates.values() for t in ts if (b := bigrams_of(t))]
    rows = docs.select(F.col(key).alias("doc_id"), F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ").alias("norm"))
    if not sets:
        return rows.select("doc_id", F.lit(None).cast("string").alias("license_id"), F.lit(None).cast("double").alias("dice"), F.lit(None).cast("string").alias("unit"), F.lit(0).cast("long").alias("n_licenses"))
    flat = F.trim(F.regexp_replace("norm", r"\s+", " "))
    needles = F.split(F.lit(" ".join(sorted(set().union(*(needles_of(b, least) for b in sets))))), " ")
    hit = F.arrays_overlap(F.split("flat", " "), needles)
    units = F.array_distinct(F.filter(F.transform(F.concat(F.split("norm", "\n"), F.split("norm", r"\n\s*\n"), F.array("flat")), lambda u: F.trim(F.regexp_replace(u, r"\s+", " "))), lambda u: F.contains(u, F.lit(" "))))
    smallest, largest = min(map(len, sets)) * least / (2 - least), max(map(len, sets)) * (2 - least) / least

    def bigrams(unit: Column) -> Column:
        words = F.split(unit, " ")
        return F.struct(unit.alias("unit"), F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("own"))

    # a unit without a needle of its own reaches nothing
    candidates = F.filter(units, lambda u: F.arrays_overlap(F.split(u, " "), needles))
    split = F.filter(F.transform(candidates, bigrams), lambda u: F.size(u["own"]).between(math.floor(smallest), math.ceil(largest)))

    def against(u: Column) -> Column:
        size = F.size(u["own"])
        fit = F.filter(_template_array(templates), lambda t: (t["size"] * (2 - least) >= size * least - 1e-9) & (size * (2 - least) >= t["size"] * least - 1e-9))
        scored = F.transform(fit, lambda t: F.struct(F.size(F.array_intersect(u["own"], t["bigrams"])).alias("shared"), (size + t["size"]).alias("all"), t["id"].alias("id"), u["unit"].alias("unit")))
        return F.filter(scored, lambda x: 2.0 * x["shared"] / x["all"] >= least - 1e-9)

    found = rows.withColumn("flat", flat).withColumn("matches", F.when(hit, F.flatten(F.transform(split, against))))
    # least by (-shared, all, id, unit): of as many shared bigrams, the fewest in all have the highest Dice
    best = F.array_min(F.transform("matches", lambda x: F.struct((-x["shared"]).alias("less"), x["all"].alias("all"), x["id"].alias("id"), x["unit"].alias("unit"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.col("best.id").alias("license_id"),
        (F.lit(-2.0) * F.col("best.less") / F.col("best.all")).alias("dice"),
        F.col("best.unit").alias("unit"),
        F.coalesce(F.size(F.array_distinct(F.transform("matches", lambda x: x["id"]))), F.lit(0)).cast("long").alias("n_licenses"),
    )
