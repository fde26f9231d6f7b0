"""What stands around a model: budgets, prompts and premises within them, softmax, and checks of stored vectors.

Models and tokenizers come in as functions; `whitespace` is the tokenizer of the registered queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragstone.functions.vectors import norm

# The frames that prompts and premises are rendered in.
CHUNK_HEADER = "[CHUNK {rank}]\n"
PREMISE_MARKER = "[Retrieved chunk rank {rank}]"
TEMPLATE = "Answer the question from the context alone.\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"


@dataclass(frozen=True)
class Tokenizer:
    """encode gives token ids or strings, decode a text for them; pair_special: tokens that a pair of texts adds."""

    encode: Callable[[str], list]
    decode: Callable[[list], str]
    pair_special: int = 3


whitespace = Tokenizer(lambda text: re.findall(r"\s*\S+", text), lambda tokens: "".join(tokens))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def claim_budget(claims: DataFrame, key: list[str], most: int, tokenizer: Tokenizer = whitespace) -> DataFrame:
    """Per response: claims, the longest claim in tokens, claims beyond the budget, and whether all can be evaluated.

    A claim fits if its tokens and a pair's special ones are fewer than `most`; none is ever cut. claims: key, text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(tokenizer.encode(t or "")) for t in batch.column("text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], sizes], names=[*key, "size"])

    kinds = dict(claims.dtypes)
    sized = claims.select(*key, "text").mapInArrow(measure, ", ".join([*[f"{k} {kinds[k]}" for k in key], "size int"]))
    over = F.col("size") + tokenizer.pair_special >= most
    return sized.groupBy(*key).agg(
        F.count(F.lit(1)).alias("claims"), F.max("size").alias("longest"), F.count_if(over).alias("exceeding"), (F.count_if(over) == 0).alias("evaluable")
    )


def head_tail(tokens: list, budget: int) -> list:
    """The first and the last tokens within a budget, one more of the first if it is odd."""
    if len(tokens) <= budget:
        return tokens
    if budget <= 0:
        raise ValueError("no budget for a premise")
    head = (budget + 1) // 2
    return tokens[:head] + (tokens[len(tokens) - (budget - head) :])


def render_premise(claim: str, units: list[tuple[int, str]], most: int, tokenizer: Tokenizer = whitespace) -> str:
    """The units (rank, text) of a claim's context, each cut to an equal share of what the claim leaves, head and tail
    kept; joined texts that come out longer than counted lose a token at a time from the last of the largest shares."""
    if not units:
        raise ValueError("a premise needs a unit")
    size = lambda text: len(tokenizer.encode(text))
    markers = [PREMISE_MARKER.format(rank=rank) for rank, _ in units]
    room = most - size(claim) - tokenizer.pair_special
    if room <= 0:
        raise ValueError("a claim exceeds the pair's budget")
    share, extra = divmod(room - sum(map(size, markers)) - 2 * len(markers), len(units))
    budgets = [share + (i < extra) for i in range(len(units))]
    bodies = [tokenizer.encode(text) for _, text in units]
    while True:
        kept = [tokenizer.decode(head_tail(body, budget)) for body, budget in zip(bodies, budgets)]
        premise = "\n\n".join(f"{marker}\n{text}" for marker, text in zip(markers, kept))
        if size(premise) <= room:
            return premise
        largest = max(budgets)
        if largest <= 1:
            raise ValueError("the markers alone exceed the budget")
        budgets[max(i for i, b in enumerate(budgets) if b == largest)] -= 1


def rendered_premises(pairs: DataFrame, key: list[str], most: int, tokenizer: Tokenizer = whitespace) -> DataFrame:
    """key, premise. pairs: key, claim, units (array of rank and text)."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                render_premise(claim, [(u["rank"], u["text"]) for u in units], most, tokenizer)
                for claim, units in zip(batch.column("claim").to_pylist(), batch.column("units").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], pa.array(made, pa.string())], names=[*key, "premise"])

    kinds = dict(pairs.dtypes)
    return pairs.select(*key, "claim", "units").mapInArrow(render, ", ".join([*[f"{k} {kinds[k]}" for k in key], "premise string"]))


def fill_template(template: str, question: str, context: str) -> str:
    """A prompt from a template with exactly the fields question and context, neither of them blank."""
    fields = set(re.findall(r"(?<!\{)\{([A-Za-z_]*)\}(?!\})", template))
    if fields != {"question", "context"}:
        raise ValueError(f"the template has the fields {sorted(fields)}")
    if not question.strip() or not context.strip():
        raise ValueError("a prompt needs a question and a context")
    return template.replace("{question}", "\0").replace("{context}", context).replace("\0", question)


def assemble(question: str, chunks: list[tuple[int, str, str]], most: int, template: str, tokenizer: Tokenizer) -> dict:
    """The context that fits a prompt of `most` tokens: whole chunks (rank, id, text) by rank while the rendered prompt
    fits, then the longest prefix of the next one that does, found by bisection, and nothing after it."""
    size = lambda blocks: len(tokenizer.encode(fill_template(template, question, "\n\n".join(blocks))))
    blocks, seen, whole, cut = [], [], 0, None
    for rank, name, text in sorted(chunks):
        header = CHUNK_HEADER.format(rank=rank)
        if size([*blocks, header + text]) <= most:
            blocks, seen, whole = [*blocks, header + text], [*seen, name], whole + 1
            continue
        tokens = tokenizer.encode(text)
        fits, least, beyond = 0, 0, len(tokens)
        while least < beyond:  # the most tokens that fit lie in [least, beyond)
            middle = (least + beyond) // 2
            part = tokenizer.decode(tokens[:middle])
            if not part.strip():
                least = middle + 1
            elif size([*blocks, header + part]) <= most:
                fits, least = middle, middle + 1
            else:
                beyond = middle
        if fits:
            blocks, seen, cut = [*blocks, header + tokenizer.decode(tokens[:fits])], [*seen, name], (name, len(tokens), fits)
        break
    if not blocks:
        raise ValueError("the budget fits no context")
    context = "\n\n".join(blocks)
    return {
        "prompt_tokens": size(blocks), "whole_chunks": whole, "cut_chunk": cut and cut[0], "cut_from": cut and cut[1], "cut_to": cut and cut[2],
        "left_out": len(chunks) - len(seen), "visible": seen, "context_sha256": hashlib.sha256(context.encode()).hexdigest(), "context": context,
    }


def assembled_prompts(conditions: DataFrame, key: list[str], most: int, template: str = TEMPLATE, tokenizer: Tokenizer = whitespace) -> DataFrame:
    """key and assemble()'s fields. conditions: key, question, chunks (array of rank, chunk_id, text; ranks from 1 on)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for question, chunks in zip(batch.column("question").to_pylist(), batch.column("chunks").to_pylist()):
                given = [(c["rank"], c["chunk_id"], c["text"]) for c in chunks]
                if sorted(r for r, _, _ in given) != list(range(1, len(given) + 1)):
                    raise ValueError("ranks aren't 1, 2, ...")
                rows.append(assemble(question, given, most, template, tokenizer))
            fields = pa.Table.from_pylist(rows, schema=ASSEMBLED).to_batches()
            for part in fields:
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *part.columns], names=[*key, *ASSEMBLED.names])

    kinds = dict(conditions.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in key], ASSEMBLED_DDL])
    return conditions.select(*key, "question", "chunks").mapInArrow(build, schema)


ASSEMBLED = pa.schema(
    [
        ("prompt_tokens", pa.int32()), ("whole_chunks", pa.int32()), ("cut_chunk", pa.string()), ("cut_from", pa.int32()), ("cut_to", pa.int32()),
        ("left_out", pa.int32()), ("visible", pa.list_(pa.string())), ("context_sha256", pa.string()), ("context", pa.string()),
    ]
)
ASSEMBLED_DDL = (
    "prompt_tokens int, whole_chunks int, cut_chunk string, cut_from int, cut_to int, left_out int, visible array<string>, "
    "context_sha256 string, context string"
)


def vector_checks(vectors: DataFrame, dimension: int, tolerance: float = 1e-5) -> DataFrame:
    """One row: vectors, wrong_dimension, not_finite, not_unit, minimum_norm, maximum_norm; norms over sound vectors."""
    v = F.col("embedding")
    shaped = v.isNotNull() & (F.size(v) == dimension)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    length = F.when(shaped & finite, norm(v))
    return vectors.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(~shaped).alias("wrong_dimension"),
        F.count_if(shaped & ~F.coalesce(finite, F.lit(False))).alias("not_finite"),
        F.count_if(F.abs(length - 1) > tolerance).alias("not_unit"),
        F.min(length).alias("minimum_norm"),
        F.max(length).alias("maximum_norm"),
    )
