"""Model prices and the cost of a call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: model -> provider, dollars per million input and output tokens
PRICES = {
    "openai/gpt-5-mini": ("OpenAI", 0.3, 1.25),
    "openai/gpt-4o-mini": ("OpenAI", 0.15, 0.6),
    "openai/text-embedding-3-small": ("OpenAI", 0.02, 0.0),
    "bedrock/cohere.rerank-v3-5:0": ("Bedrock", 2.0, 0.0),
    "amazon-bedrock/us.anthropic.claude-haiku-4-5-20251001-v1:0": ("Bedrock", 0.8, 4.0),
}
MODELS = tuple(PRICES)


def _of(model: Column, at: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for m, p in PRICES.items() for x in (m, p[at]))), model)


def provider(model: Column) -> Column:
    return _of(model, 0)


def cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Dollars with eight decimals; null for a model without a price."""
    dollars = input_tokens / F.lit(1_000_000.0) * _of(model, 1) + output_tokens / F.lit(1_000_000.0) * _of(model, 2)
    return dollars.cast("decimal(12,8)")
