"""Text refinement loops around an injected client: evaluate, criticise, update."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class TextClient(Protocol):
    def complete(self, instruction: str, text: str) -> str: ...


@dataclass(frozen=True)
class Refined:
    text: str
    critiques: tuple[str, ...]


EVALUATE, UPDATE = "Say what is wrong with this text for its purpose: ", "Rewrite this text so that the critique no longer holds: "


def refine(client: TextClient, text: str, purpose: str, iterations: int = 3) -> Refined:
    """`iterations` rounds of critique and rewrite; an empty rewrite keeps the text."""
    critiques = []
    for _ in range(max(0, iterations)):
        critiques.append(client.complete(EVALUATE + purpose, text))
        text = client.complete(UPDATE + critiques[-1], text) or text
    return Refined(text, tuple(critiques))


def refine_query(client: TextClient, query: str, iterations: int = 3) -> Refined:
    return refine(client, query, "a search query", iterations)


def refine_answer(client: TextClient, question: str, context: str, draft: str | None = None, iterations: int = 3) -> Refined:
    """Refines the given draft, or one that the client writes first."""
    return refine(client, draft or client.complete(f"Answer from the context: {context}", question), f"an answer to {question} from {context}", iterations)


def refine_plan(client: TextClient, query: str, feedback: str, iterations: int = 3) -> Refined:
    return refine(client, client.complete("Write a numbered plan", query), f"a plan for {query}, given {feedback}", iterations)


def optimize_prompt(client: TextClient, prompt: str, inputs: Iterable[str], behaviour: str, iterations: int = 10) -> Refined:
    """Each round answers every input under the prompt, criticises each answer, and rewrites the prompt once from all critiques."""
    inputs, critiques = list(inputs), []
    for _ in range(max(0, iterations)):
        losses = [client.complete(EVALUATE + behaviour, client.complete(prompt, x)) for x in inputs]
        critiques.append("\n".join(losses))
        prompt = client.complete(UPDATE + critiques[-1], prompt) or prompt
    return Refined(prompt, tuple(critiques))


def refine_all(requests: DataFrame, make_client, iterations: int = 3) -> DataFrame:
    """Refined texts of requests (id, text, purpose); make_client builds one client in each task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "text": [refine(client, t, p, iterations).text for t, p in zip(pdf["text"], pdf["purpose"])]})

    return requests.select("id", "text", "purpose").mapInPandas(work, "id long, text string")
