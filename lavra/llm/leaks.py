"""Evaluation texts inside a corpus.

A generalised suffix automaton over the words of the test items is walked with
the words of every document; at each word it holds the longest stretch that also
stands in an item. Stretches of one item that lie on nearly the same diagonal are
aligned word by word, and a document is reported for an item when the alignment
holds the whole item or enough consecutive words of it.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.words import near, word_spans, words


@dataclass(frozen=True)
class Limits:
    """When a passage counts, and how large a block of items may be.

    A passage counts from ``consecutive`` words of an item on, or when it holds
    the item whole; of every ``slack`` words one may be missing, added or misspelt.
    ``block_words`` bounds the item words that one automaton holds and one
    broadcast carries; more items are taken in several blocks. Documents are read
    and folded once for as many blocks as ``pass_words`` item words make, which is
    what a worker holds at a time.
    """

    consecutive: int = 20
    slack: int = 6
    block_words: int = 100_000
    pass_words: int = 400_000
    seed: int = 4
    short_seed: int = 3


class Automaton:
    """Suffix automaton of several word sequences, with the places where each state's words end."""

    def __init__(self, sequences: list[tuple[int, list[str]]], limits: Limits):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, sequence in sequences:
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                ends[last].append((key, at))
        short = {k for k, s in sequences if limits.short_seed <= len(s) < limits.consecutive}
        # Items of fewer words than a seed are their own seeds.
        brief = {k: len(s) for k, s in sequences if len(s) < limits.short_seed}
        self.brief: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in set(brief.values())}
        self.seeds: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            below, here = self.length[self.link[state]], ends.get(state, [])
            if here and below > 0:
                ends[self.link[state]].extend(here)
            if below < limits.seed <= self.length[state]:
                self.seeds[state] = [x for x in here if x[0] not in short and x[0] not in brief]
            if below < limits.short_seed <= self.length[state]:
                self.short[state] = [x for x in here if x[0] in short]
            for n, own in self.brief.items():
                if below < n <= self.length[state]:
                    own[state] = [x for x in here if brief.get(x[0]) == n]

    def _extend(self, last: int, word: str) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        state = len(length)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return state

    def _clone(self, p: int, word: str, q: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def walk(self, text: list[str]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest matching length) for every word."""
        state = size = 0
        nexts, link, length = self.next, self.link, self.length
        for at, word in enumerate(text):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                size += 1
            yield at, state, size

    def ancestor(self, state: int, size: int) -> int:
        """The state of the last ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state


def _misspelt(word: str, other: str, edge: bool) -> bool:
    return near(word, other, 2) if edge else len(word) > 2 and near(word, other, 2 if len(word) > 7 else 1)


def reach(item: list[str], text: list[str], most: int) -> list[tuple[int, int]]:
    """(item words, text words) that the longest common beginning has with 0, 1, .. ``most`` errors; it ends on a word of both.

    A misspelt, missing or added word is an error; a word replaced by quite
    another one ends the alignment. Per number of errors and diagonal only the
    furthest place counts. ``item`` ends where the whole item does.
    """
    best, front = [], {(0, "="): 0}
    for _ in range(most + 1):
        fresh, top = {}, best[-1] if best else (0, 0)
        for (diagonal, last), at in front.items():
            i, start = at, at
            while i < len(item) and i + diagonal < len(text) and item[i] == text[i + diagonal]:
                i += 1
            last = "=" if i > start else last
            if last == "=" and i > top[0]:
                top = (i, i + diagonal)
            options = []
            if i < len(item) and i + diagonal < len(text) and _misspelt(item[i], text[i + diagonal], i == len(item) - 1):
                options.append((diagonal, "=", i + 1))
            if i < len(item) and last != "+":
                options.append((diagonal - 1, "-", i + 1))
            if i + diagonal < len(text) and last != "-":
                options.append((diagonal + 1, "+", i))
            for to, kind, place in options:
                if fresh.get((to, kind), -1) < place:
                    fresh[to, kind] = place
        best.append(top)
        front = fresh
    return best


def extend(item: list[str], text: list[str], start: int, stop: int, first: int, limits: Limits) -> tuple[tuple[int, int, int, int, int] | None, int]:
    """The best passage around a seed, as (item from, to, text from, to, errors), and the end in the text of the seed's errorless run.

    The seed is ``item[start:stop]`` and begins at ``text[first]``. Errors count
    over the whole passage, wherever in it they stand.
    """
    most, last = len(item) // limits.slack, first + stop - start
    before = reach(item[:start][::-1], text[max(0, first - start - most) : first][::-1], most)
    after = reach(item[stop:], text[last : last + len(item) - stop + most], most)
    best = None
    for e, (i, j) in enumerate(before):
        for f, (k, m) in enumerate(after[: most - e + 1]):
            size, errors = i + stop - start + k, e + f
            # A word that a whole item lacks at its ends is missing like any other.
            lacking = len(item) - size
            if size < limits.consecutive and lacking and (errors + lacking) * limits.slack <= len(item):
                size, errors = len(item), errors + lacking
            if errors * limits.slack <= size and (size >= limits.consecutive or size == len(item)):
                # An error must bring a word of both besides its own, lest chance words lengthen the passage.
                found = (size == len(item), size - 2 * errors, stop + k - (start - i)), (start - i, stop + k, first - j, last + m, errors)
                best = found if best is None else max(best, found, key=lambda x: x[0])
    return best[1] if best else None, last + after[0][1]


def _seeds_left(size: int, limits: Limits) -> int:
    """Seeds that the least passage of an item still shows after as many errors as it may have."""
    least, seed = (size, limits.short_seed) if size < limits.consecutive else (limits.consecutive, limits.seed)
    errors = least // limits.slack
    return max(1, least - errors - (seed - 1) * (errors + 1))


def scan(text: list[str], items: dict[int, list[str]], automaton: Automaton, limits: Limits) -> list[tuple[int, int, int, int, int, int]]:
    """(item, item from, to, text from, to, errors) of every item that the text holds."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    nexts, link, length, least = automaton.next, automaton.link, automaton.length, min([limits.short_seed, *automaton.brief])
    state = size = 0
    # As in Automaton.walk; words that lead nowhere are passed over.
    for at, word in enumerate(text):
        to = nexts[state].get(word)
        while to is None and state:
            state = link[state]
            size = length[state]
            to = nexts[state].get(word)
        if to is None:
            continue
        state, size = to, size + 1
        if size < least:
            continue
        for n, own in automaton.brief.items():
            if size >= n:
                for key, end in own.get(automaton.ancestor(state, n), ()):
                    hits[key].append((at - end, at))
        if size >= limits.short_seed:
            for key, end in automaton.short.get(automaton.ancestor(state, limits.short_seed), ()):
                hits[key].append((at - end, at))
            if size >= limits.seed:
                for key, end in automaton.seeds.get(automaton.ancestor(state, limits.seed), ()):
                    hits[key].append((at - end, at))
    found = []
    for key, places in hits.items():
        item = items[key]
        enough = _seeds_left(len(item), limits)
        if len(places) < enough:
            continue
        least = min(len(item), limits.consecutive)
        drift, reach_words = least // limits.slack, least + least // limits.slack
        places = sorted({(at, diagonal) for diagonal, at in places})
        done, tried = -1, {}
        seed = min(len(item), limits.short_seed) if len(item) < limits.consecutive else limits.seed
        for at, diagonal in places:
            # Only seeds that lie close together, on nearly one diagonal, are worth an alignment; those of one errorless run give the same.
            if at <= max(done, tried.get(diagonal, -1)) or len({a for a, d in places if at <= a < at + reach_words and abs(d - diagonal) <= drift}) < enough:
                continue
            stop = at - diagonal + 1
            held, end = extend(item, text, stop - seed, stop, at + 1 - seed, limits)
            tried[diagonal] = end - 1
            if held:
                found.append((key, *held))
                done = held[3]
    return found


def blocks(items: DataFrame, id: str, text: str, limits: Limits) -> Iterator[list[tuple[int, list[str]]]]:
    """The items' words, in blocks of about ``block_words``; one block at a time is on the driver."""
    sized = items.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    total = sized.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = max(1, math.ceil(total / limits.block_words))
    part = F.pmod(F.xxhash64("id"), F.lit(count))
    for k in range(count):
        # A block is bounded by block_words, whatever the number of items.
        block = [(r.id, w) for r in sized.where(part == k).collect() if (w := words(r.text))]
        if block:
            yield block


_OUT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("item", T.LongType()), T.StructField("item_from", T.IntegerType()), T.StructField("item_to", T.IntegerType()), T.StructField("doc_from", T.IntegerType()), T.StructField("doc_to", T.IntegerType()), T.StructField("errors", T.IntegerType()), T.StructField("item_words", T.IntegerType()), T.StructField("doc_words", T.IntegerType())])
#: The automata of the pass that this worker made last, by the pass's name.
_BUILT: dict[str, list[tuple[dict, Automaton]]] = {}


def passages(documents: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "texto", limits: Limits = Limits()) -> DataFrame:
    """Every passage of an item in a document, as word positions.

    Null, empty and blank texts hold nothing; repeated documents each give their
    own rows, as do repeated passages in one document. Equal texts under several
    item ids are each found. Ids must be whole numbers. Whole texts are read.
    """
    spark = documents.sparkSession
    texts = documents.where(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    slots = spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < slots:
        texts = texts.repartition(slots)
    together = max(1, limits.pass_words // limits.block_words)
    result, carried = None, []

    def scanned(blocks_: list) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = [(dict(b.value), Automaton(b.value, limits)) for b in blocks_]
            for batch in batches:
                rows = []
                for doc, value in zip(batch["doc"], batch["text"]):
                    text_words = words(value)
                    for sequences, automaton in _BUILT[name]:
                        rows += [(doc, *hit, len(sequences[hit[0]]), len(text_words)) for hit in scan(text_words, sequences, automaton, limits)]
                yield pd.DataFrame(rows, columns=_OUT.names)

        return texts.mapInPandas(run, _OUT)

    for block in blocks(items, item_id, item_text, limits):
        carried.append(spark.sparkContext.broadcast(block))
        if len(carried) == together:
            result, carried = scanned(carried) if result is None else result.unionByName(scanned(carried)), []
    if carried:
        result = scanned(carried) if result is None else result.unionByName(scanned(carried))
    return spark.createDataFrame([], _OUT) if result is None else result


def leaked_pairs(found: DataFrame) -> DataFrame:
    """One row per document and item: passages, words held and share of the item."""
    return found.groupBy("doc", "item").agg(F.count("*").alias("trechos"), F.max(F.col("item_to") - F.col("item_from")).cast("bigint").alias("palavras"), F.round(F.max((F.col("item_to") - F.col("item_from")) / F.col("item_words")), 4).alias("cobertura"))


def cleaned(documents: DataFrame, found: DataFrame, *, id: str = "doc_id", text: str = "text", drop_share: float = 0.5) -> DataFrame:
    """Documents with held passages cut out; dropped whole where more than ``drop_share`` of the words is held.

    Only documents with passages come out: ``texto_limpo`` is null for dropped ones.
    The cut text keeps the original spelling around the passages.
    """
    spans = found.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("doc_from", "doc_to"))).alias("spans"), F.max("doc_words").alias("doc_words"))
    joined = documents.select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text")).join(spans, "doc")

    @F.pandas_udf(T.StructType([T.StructField("texto_limpo", T.StringType()), T.StructField("palavras_removidas", T.LongType())]))
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        from lavra.llm.leaks import _cut

        return pd.DataFrame([_cut(t, s, drop_share) for t, s in zip(texts, spans)], columns=["texto_limpo", "palavras_removidas"])

    return joined.select("doc", cut("text", "spans").alias("c")).select("doc", "c.*")


def _cut(text: str, spans, drop_share: float) -> tuple[str | None, int]:
    places = word_spans(text)
    removed = sorted({k for span in spans for k in range(span["doc_from"], span["doc_to"])})
    if len(removed) > drop_share * len(places):
        return None, len(removed)
    out, last = [], 0
    for n, k in enumerate(removed):
        if n and removed[n - 1] == k - 1:
            last = places[k][1]
            continue
        out.append(text[last : places[k][0]])
        last = places[k][1]
    return "".join([*out, text[last:]]), len(removed)
