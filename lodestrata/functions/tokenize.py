"""Token counts for chunking. The default tokenizer is a pattern whose tokens join to the text again."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"\w+|[^\w\s]|\s+"
_TOKEN = re.compile(PATTERN)


class Tokenizer(Protocol):
    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class PatternTokenizer:
    def encode(self, text: str) -> list[str]:
        return _TOKEN.findall(text)

    def starts(self, text: str) -> list[int]:
        """Where each token begins; it ends where the next one does."""
        return list(accumulate(map(len, _TOKEN.findall(text)), initial=0))[:-1]

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens)


@dataclass
class TiktokenTokenizer:
    """A byte-pair vocabulary from a local rank file."""

    path: str
    pattern: str

    def _encoding(self):
        import base64

        import tiktoken

        if not hasattr(self, "_enc"):
            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._enc = tiktoken.Encoding("local", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._enc

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern}

    def encode(self, text: str) -> list[int]:
        return self._encoding().encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self._encoding().decode(tokens)


def tokens(text: Column) -> Column:
    """The pattern's tokens as a column."""
    return F.regexp_extract_all(text, F.lit(f"(?U){PATTERN}"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def last_tokens(text: Column, n: int) -> Column:
    t = tokens(text)
    return F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - n + 1), n), "")
