"""Fill-in-the-middle: texts cut into line units, with the middle moved behind the rest.

One fullmatch of a repeated group keeps every repetition, so the ends of the captures are the ends of all
units: their number is n, and the two cuts are read off by index. Marks around the parts make the
transformation reversible; a text that holds a mark already stays as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import map_batches

#: fixed values: the marks in front of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: all units of a text as the captures of one group; possessive, so a match never goes back
_UNITS = regex.compile(r"([^\n]*+\n|[^\n]++)*+")


@dataclass(frozen=True)
class Rule:
    """How texts are transformed: the seed of the draws, and shares in percent."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50


def draws(rule: Rule, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the id; a missing id is an empty one."""
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))
    return h1, h2, h3, h4


def unit_ends(text: str) -> list[int]:
    """End of every line unit, in code points."""
    return _UNITS.fullmatch(text).ends(1)


def transform(text: str, doc_id: int | None, rule: Rule) -> tuple[int, str, int | None, int | None, str]:
    """(n units, form, code points of the prefix, of the middle, output); no parts where the form is plain."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(rule, doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rule.transformed:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first = ends[low - 1] if low else 0
    second = ends[high - 1] if high else 0
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < rule.suffix_first:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again, from the output and its form alone."""
    if form == "plain":
        return output
    front, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = front.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = front.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def _rows(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple]:
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        yield doc_id, *transform(text.as_py() or "", doc_id, rule)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; only doc_id and text are read.

    A missing or empty text is one of no units and stays plain. Draws depend on the id alone, so repeated
    rows come out alike, and rows without an id share their draws. No row meets another: there is no
    exchange, and a task holds one batch of texts.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(_rows(batch, rule))
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64()), ("output", pa.string()),
        ])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
        )

    return map_batches(
        _named(docs), run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(transformed: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with ``restored``, the text rebuilt from ``output`` and ``form``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms = batch.column("form").to_pylist()
        texts = [restore(o.as_py(), f) for o, f in zip(batch.column("output"), forms, strict=True)]
        return batch.append_column("restored", pa.array(texts, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return map_batches(transformed, run, f"{fields}, restored string")
