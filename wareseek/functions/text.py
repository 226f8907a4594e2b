"""Text columns: tokens, prompts, labels and image lists. Everything stays in the JVM, but for prompts made in a task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from wareseek.schemas import (
    FACETS,
    IMAGE_PLACEHOLDER,
    IMAGE_PLACEHOLDER_COUNT,
    LABEL_OUTPUT_BUFFER_TOKENS,
)

WHITESPACE = " \t\n\r\x0b\x0c"
_SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), _SEPARATORS), lambda t: t != "")


def has_token(text: Column) -> Column:
    """Whether :func:`tokens` would find anything, without splitting the text."""
    return text.rlike(r"[\p{L}\p{N}]")


def token_count(token_list: Column) -> Column:
    """Length of a token list; NULL for a missing list."""
    return F.array_size(token_list)


def is_blank(text: Column) -> Column:
    return F.length(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))) == 0


def primary_image(images: Column) -> Column:
    """The last entry of a ``;`` separated list, without surrounding whitespace."""
    return F.btrim(F.substring_index(images, ";", -1), F.lit(WHITESPACE))


def clean_label(response: Column, labels: Sequence[str], whole_words: bool = False) -> Column:
    """The one label the response mentions (ignoring case), NULL for none or several.

    The default is a substring test, so "colored" mentions "Red"; ``whole_words`` asks for word
    boundaries instead. Written as plain conditions so that it compiles with the rest of the stage
    and lower-cases the response once.
    """
    if whole_words:
        mentions = [response.rlike(rf"(?i)\b{label}\b") for label in labels]
    else:
        text = F.lower(response)
        mentions = [F.contains(text, F.lit(label.lower())) for label in labels]
    hits = sum((m.cast("int") for m in mentions[1:]), mentions[0].cast("int"))
    named = F.coalesce(*[F.when(m, F.lit(label)) for m, label in zip(mentions, labels)])
    return F.when(hits == 1, named)


def term_frequencies(sorted_tokens: Column, run_starts: Column) -> Column:
    """``array<struct<term, tf>>`` from sorted tokens and the positions where a new term begins."""
    end = lambda i: F.coalesce(F.try_element_at(run_starts, i + 2), F.size(sorted_tokens))
    return F.transform(
        run_starts,
        lambda start, i: F.struct(
            F.get(sorted_tokens, start).alias("term"), (end(i) - start).alias("tf")
        ),
    )


def run_starts(sorted_tokens: Column) -> Column:
    """Positions in a sorted, non-empty array that differ from their left neighbour."""
    return F.filter(
        F.sequence(F.lit(0), F.size(sorted_tokens) - 1),
        lambda i: (i == 0) | (F.get(sorted_tokens, i) != F.get(sorted_tokens, i - 1)),
    )


@dataclass(frozen=True)
class Prompt:
    """Text around named columns: ``parts`` alternates literal, column, literal, ..., literal.

    Every column must be fenced by characters that separate tokens. The token count of the whole
    is then the sum over its parts, and the literals (such as the long run of image placeholders)
    never have to be tokenised per row.
    """

    parts: tuple[str, ...]

    def __post_init__(self) -> None:
        literals = self.parts[0::2]
        fenced = all(
            (i == 0 or not text[:1].isalnum()) and (i == len(literals) - 1 or not text[-1:].isalnum())
            for i, text in enumerate(literals)
        )
        if len(self.parts) % 2 == 0 or not all(literals[1:-1]) or not fenced:
            raise ValueError("prompt literals must separate the columns they surround")

    def text(self) -> Column:
        return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(self.parts)])

    def fill(self, **values: str) -> str:
        """The same text for one row, inside a task."""
        return "".join(values[p] if i % 2 else p for i, p in enumerate(self.parts))

    def texts(self, rows: pa.RecordBatch) -> pa.Array:
        """:meth:`text` for the rows of a batch, inside a task; the columns must be strings."""
        kind = rows.schema.field(self.parts[1]).type
        parts = [rows.column(p).cast(kind) if i % 2 else pa.scalar(p, kind) for i, p in enumerate(self.parts)]
        return pc.binary_join_element_wise(*parts, pa.scalar("", kind))

    def count(self, counts: dict[str, Column]) -> Column:
        """Token count, given the token count of each column."""
        fixed = F.lit(sum(len(split_tokens(p)) for p in self.parts[0::2]))
        return sum((counts[name] for name in self.parts[1::2]), fixed)


def split_tokens(text: str) -> list[str]:
    """:func:`tokens` for one string known on the driver: a query, a label or a template."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


DESCRIPTION_PROMPT = Prompt(
    (
        IMAGE_PLACEHOLDER * IMAGE_PLACEHOLDER_COUNT
        + "\nUSER: Write a product description for a shop page. The product is called: ",
        "name",
        ". Mention the color seen in the picture.\nASSISTANT:",
    )
)

# The remote describer receives the picture next to the prompt, so this one has no placeholders.
REMOTE_DESCRIPTION_PROMPT = Prompt(
    ("Write a product description for a shop page. The product is called: ", "name", ".")
)


def label_prompt(facet: str, labels: Sequence[str]) -> Prompt:
    return Prompt(
        (
            "Product title: ",
            "name",
            "\nProduct description: ",
            "description",
            f"\nWhich {facet} fits the product best? Answer with one of these words only: "
            + ", ".join(labels)
            + ".",
        )
    )


LABEL_PROMPTS = {facet: label_prompt(facet, labels) for facet, labels in FACETS.items()}


def longest_label(labels: Sequence[str]) -> str:
    """First of the longest labels."""
    return max(labels, key=len)


def label_output_tokens(labels: Sequence[str]) -> int:
    """Output allowance for a classifier: its longest label plus room for a wordy answer."""
    return len(split_tokens(longest_label(labels))) + LABEL_OUTPUT_BUFFER_TOKENS
