"""Cutting documents, pages, table rows and conversations into chunks of bounded size.

What depends on one text only is a small function applied in Arrow batches, without a shuffle. What
relates chunks to pages is joins and windows. Rows are packed by a fold over their sizes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import trimmed
from ..functions.tokenize import PatternTokenizer, Tokenizer, last_tokens, token_count

#: Where a text may be cut, coarse to fine (fixed values).
BREAKS = ("\n\n", "\n", ". ", "? ", "! ", "; ", " ")


#: Characters of a bin in which pages and chunks meet.
BIN = 4096


@dataclass(frozen=True)
class Size:
    most: int = 400
    overlap: int = 80
    least: int = 40


class Ends:
    """A text's tokens by their places: how many a stretch of it has, and where its last ones begin.

    Tokens of the pattern follow each other without a gap, and what a break can cut is white space, both parts
    of which are a token again; so a stretch has as many tokens as it touches, and the text is encoded once.
    """

    def __init__(self, text: str, tok: PatternTokenizer):
        self.starts = tok.starts(text)

    def count(self, a: int, b: int) -> int:
        return bisect_left(self.starts, b) - bisect_right(self.starts, a) + 1 if a < b else 0

    def last(self, a: int, b: int, n: int) -> int:
        """Where the last n tokens of a stretch begin."""
        return max(a, self.starts[max(0, bisect_left(self.starts, b) - n)])


class Encoded:
    """The same for a tokenizer whose tokens of a stretch aren't those of the whole: each stretch is encoded."""

    def __init__(self, text: str, tok: Tokenizer):
        self.text, self.tok = text, tok

    def count(self, a: int, b: int) -> int:
        return len(self.tok.encode(self.text[a:b]))


def segments(text: str, a: int, b: int, most: int, tokens, level: int = 0) -> Iterator[tuple[int, int]]:
    """Stretches of text[a:b] of at most most tokens, one after another, cut at the coarsest break that will do; the break stays at the left."""
    if tokens.count(a, b) <= most:
        yield a, b
    elif level == len(BREAKS):
        if isinstance(tokens, Ends):
            first = bisect_right(tokens.starts, a) - 1
            cuts = [a, *tokens.starts[first + most : bisect_left(tokens.starts, b) : most], b]
        else:
            ids = tokens.tok.encode(text[a:b])
            lengths = [len(tokens.tok.decode(ids[i : i + most])) for i in range(0, len(ids), most)]
            cuts = [a, *(a + sum(lengths[: i + 1]) for i in range(len(lengths)))]
        yield from zip(cuts, cuts[1:])
    else:
        mark = BREAKS[level]
        at = a
        while (found := text.find(mark, at, b)) >= 0:
            yield from segments(text, at, found + len(mark), most, tokens, level + 1)
            at = found + len(mark)
        yield from segments(text, at, b, most, tokens, level + 1)


def joined_up(parts: Iterator[tuple[int, int]], size: Size, tokens) -> list[tuple[int, int]]:
    """Neighbouring segments joined while they fit; one left too small goes to the chunk before if there is room."""
    runs: list[list[int]] = []  # begin, end and sum of its segments' tokens
    for a, b in parts:
        n = tokens.count(a, b)
        if runs and runs[-1][2] + n <= size.most:
            runs[-1][1] = b
            runs[-1][2] += n
        else:
            runs.append([a, b, n])
    out: list[tuple[int, int]] = []
    for a, b, n in runs:
        if n < size.least and out and tokens.count(*out[-1]) + n <= size.most:
            out[-1] = out[-1][0], b
        elif a < b:
            out.append((a, b))
    return out


def split_text(text: str, size: Size = Size(), tok: Tokenizer | None = None) -> list[str]:
    """Chunks of a text, each led by the last tokens of the one before. A text that fits is one chunk, or none if it is blank or too small."""
    tok = tok or PatternTokenizer()
    tokens = Ends(text, tok) if isinstance(tok, PatternTokenizer) else Encoded(text, tok)
    n = tokens.count(0, len(text))
    if n <= size.most:
        return [text] if text.strip() and n >= size.least else []
    base = joined_up(segments(text, 0, len(text), size.most, tokens), size, tokens)
    if size.overlap <= 0:
        return [text[a:b] for a, b in base]
    if isinstance(tokens, Ends):
        return [text[base[0][0] : base[0][1]]] + [text[tokens.last(*x, size.overlap) : y[1]] for x, y in zip(base, base[1:])]
    return [text[base[0][0] : base[0][1]]] + [tok.decode(tok.encode(text[a:b])[-size.overlap :]) + text[c:d] for (a, b), (c, d) in zip(base, base[1:])]


def splitter(size: Size = Size(), tok: Tokenizer | None = None):
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, tok) if t is not None else [])

    return split


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: Size = Size(), tok: Tokenizer | None = None) -> DataFrame:
    """docs without their text, with (chunk_index, content): null and too small texts give no chunk."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(splitter(size, tok)(F.col(text))).alias("chunk_index", "content"))


def pages_touched(ranges: DataFrame, spans: DataFrame, key: str = "doc_id", bin_size: int = BIN) -> DataFrame:
    """(key, chunk_index, pages): pages (key, page, page_start, page_end) that ranges (key, chunk_index, start, end) of characters touch.

    An interval join: both sides are sent to the bins of characters that they lie in, and a pair is taken in the first bin
    that both have; so a document of many pages and chunks is many small joins, and not each chunk with each page. A page
    without characters is touched by what goes on over its place.
    """
    at = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / bin_size), F.floor(F.greatest(lo, hi, F.lit(0)) / bin_size)))
    r = ranges.select(F.col(key).alias("r_key"), "chunk_index", "start", "end", at(F.col("start"), F.col("end") - 1).alias("r_bin"))
    p = spans.select(key, "page", "page_start", "page_end", at(F.col("page_start"), F.col("page_end") - 1).alias("bin"))
    first = F.greatest(F.floor(F.greatest("start", F.lit(0)) / bin_size), F.floor(F.greatest("page_start", F.lit(0)) / bin_size))
    pairs = p.join(r, (F.col(key) == F.col("r_key")) & (F.col("bin") == F.col("r_bin"))).where((F.col("bin") == first) & (F.col("page_start") < F.col("end")) & (F.col("page_end") > F.col("start")))
    return pairs.groupBy(key, "chunk_index").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def chunk_pages(pages: DataFrame, key: str = "doc_id", size: Size = Size()) -> DataFrame:
    """(doc_id, chunk_index, content, pages) from (doc_id, page, text): chunks over page borders, with the pages each touches.

    Texts are joined in page order and cut without overlap, so places add up; then the overlap is put in
    front and a chunk's range is matched with the pages' ranges. Page lengths are the pages' own.
    """
    by = W.partitionBy(key).orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    spans = pages.withColumn("page_start", F.coalesce(F.sum(F.length("text")).over(by), F.lit(0))).withColumn("page_end", F.col("page_start") + F.length("text"))
    whole = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "").alias("text"))
    base = whole.select(key, F.posexplode(splitter(Size(size.most, 0, size.least))(F.col("text"))).alias("chunk_index", "base"))
    w = W.partitionBy(key).orderBy("chunk_index")
    placed = (
        base.withColumn("start", F.coalesce(F.sum(F.length("base")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("end", F.col("start") + F.length("base"))
        .withColumn("lead", F.coalesce(last_tokens(F.lag("base").over(w), size.overlap), F.lit("")) if size.overlap > 0 else F.lit(""))
    )
    found = pages_touched(placed.select(key, "chunk_index", (F.col("start") - F.length("lead")).alias("start"), "end"), spans.select(key, "page", "page_start", "page_end"), key)
    return placed.select(key, "chunk_index", F.concat("lead", "base").alias("content")).join(found, [key, "chunk_index"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<int>")))


def row_cuts(most: int = 400):
    """Of the token counts of an ordered array of rows, where chunks end: rows are added until the next would pass most tokens."""

    @F.pandas_udf("array<int>")
    def cuts(sizes: pd.Series) -> pd.Series:
        def one(ns):
            out, held = [], 0
            for i, n in enumerate(ns):
                if i > (out[-1] if out else 0) and held + n > most:
                    out.append(i)
                    held = n
                else:
                    held += n + (held > 0)
            return [*out, len(ns)]

        return sizes.map(lambda ns: None if ns is None else one(ns))

    return cuts


def packed_rows(rows: Column, most: int = 400) -> Column:
    """Chunks (row, content) of an ordered array of (row, text): rows are added until the next would pass most tokens.

    A row is never cut, a line break counts as a token once it is in, and no chunk is too small. One walk over the rows' token counts gives
    the places of cuts; contents are sliced from the rows afterwards, so work is in proportion to the file.
    """
    ends = row_cuts(most)(F.transform(rows, lambda r: token_count(r["text"]).cast("int")))
    chunk = lambda b, e: F.struct(F.get(rows, b)["row"].alias("row"), F.array_join(F.transform(F.slice(rows, b + 1, e - b), lambda r: r["text"]), "\n").alias("content"))
    begins = lambda e: F.concat(F.array(F.lit(0)), F.slice(e, 1, F.size(e) - 1))
    cut_at = F.get(F.transform(F.array(ends), lambda e: F.zip_with(begins(e), e, chunk)), 0)
    return F.when(F.size(rows) == 0, F.array().cast("array<struct<row int, content string>>")).otherwise(cut_at)


def csv_rows(text: Column) -> Column:
    """(columns, rows) of a file: head cells split at plain commas, and every line that isn't blank with its number."""
    lines = F.split(text, "\n")
    rows = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("row"), x.alias("text"))), lambda r: trimmed(r["text"]) != "")
    head = F.coalesce(F.get(rows, 0)["text"], F.lit(""))
    columns = F.filter(F.transform(F.split(head, ","), trimmed), lambda c: c != "")
    return F.struct(columns.alias("columns"), rows.alias("rows"))


def chunk_csv(files: DataFrame, text: str = "text", most: int = 400) -> DataFrame:
    """files without their text, with (chunk_index, row, content, columns)."""
    rest = [c for c in files.columns if c != text]
    x = files.withColumn("csv", csv_rows(F.col(text)))
    return x.select(*rest, "csv.columns", F.posexplode(packed_rows(F.col("csv.rows"), most)).alias("chunk_index", "c")).select(*rest, "chunk_index", "c.row", "c.content", "columns")


MESSAGE_CHUNK = "data_source_id string, chunk_index int, content string, context string, authors array<string>, source_url string"


class Conversation:
    """Running state of one source's messages: what is held, and the chunk that isn't sent yet."""

    def __init__(self, size: Size, tok: Tokenizer):
        self.size, self.tok = size, tok
        self.held, self.meta, self.last, self.out = "", None, None, []

    def _send(self, text: str, meta: dict) -> None:
        if self.last is not None:
            self.out.append(self.last)
        self.last = {"content": text, **meta}

    @staticmethod
    def _with(meta: dict, authors) -> dict:
        return meta | {"authors": list(dict.fromkeys([*meta["authors"], *authors]))} if meta["merges"] else meta

    def add(self, content: str, meta: dict) -> list[dict]:
        if self.meta is None:
            self.meta = meta
        # the break is decided before a flush and kept after it, so a chunk after a flush begins with one
        mark = "\n" if self.held else ""
        n = len(self.tok.encode(self.held)) + len(self.tok.encode(mark + content))
        if self.held and (n > self.size.most or self.meta["context"] != meta["context"]):
            self._send(self.held, self.meta)
            self.held, self.meta = "", meta
        elif self.meta["context"] == meta["context"] or self.meta["merges"] and meta["merges"]:
            self.meta = self._with(self.meta, meta["authors"])
        self.held += mark + content
        if len(self.tok.encode(self.held)) > self.size.most:
            for part in split_text(self.held, self.size, self.tok):
                self._send(part, self.meta)
            self.held, self.meta = "", meta
        out, self.out = self.out, []
        return out

    def end(self) -> list[dict]:
        if self.held:
            if self.last is not None and len(self.tok.encode(self.held)) < self.size.least:
                self.last = self._with(self.last, self.meta["authors"]) | {"content": self.last["content"] + "\n" + self.held}
            else:
                self._send(self.held, self.meta)
        return self.out + ([self.last] if self.last is not None else [])


def group_messages(messages: DataFrame, size: Size = Size(), tok: Tokenizer | None = None) -> DataFrame:
    """Chunks of conversations from (data_source_id, position, content, context, authors, source_url, merges).

    Messages of one context follow each other in a chunk until it is full; where merges is true the chunk
    collects their authors. A source's messages are sorted and streamed through a task with only
    the open chunk kept, so a source may be longer than memory.
    """
    columns = ["data_source_id", "position", "content", "context", "authors", "source_url", "merges"]
    tok = tok or PatternTokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MESSAGE_CHUNK.split(", ")]
        source, talk, sent = None, None, 0

        def rows(chunks):
            nonlocal sent
            for c in chunks:
                yield (source, sent, c["content"], c["context"], c["authors"], c["source_url"])
                sent += 1

        for batch in batches:
            out = []
            for m in batch.itertuples(index=False):
                if talk is None or m.data_source_id != source:
                    out += rows(talk.end()) if talk else []
                    source, talk, sent = m.data_source_id, Conversation(size, tok), 0
                out += rows(talk.add(m.content, {"context": m.context, "authors": list(m.authors), "source_url": m.source_url, "merges": bool(m.merges)}))
            yield pd.DataFrame(out, columns=names)
        if talk:
            yield pd.DataFrame(list(rows(talk.end())), columns=names)

    spoken = messages.where(trimmed(F.col("content")) != "").select(F.col("data_source_id").cast("string"), *columns[1:])
    return spoken.repartition("data_source_id").sortWithinPartitions("data_source_id", "position").mapInPandas(run, MESSAGE_CHUNK)
