"""Language of documents and of their segments.

Every sentence is a TF-IDF vector of character n-grams, compared by cosine with
several clustered centroids of each language; a sentence nearer to none than the
training sentences are to theirs (code, figures, names) is rejected and belongs
to the segment around it. An n-gram weighs less the more evenly two languages
share it, so that centroids gather what tells languages apart, not topics that
texts of several languages have in common.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lavra.llm.grams import codes, hashes

# Language codes of two and of three letters.
THREE_LETTERS = {"por": "pt", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "ita": "it", "deu": "de", "ger": "de"}


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts, and the labelled documents, of a language that the centroids are fitted on.

    A sentence is rejected below ``reject`` times the cosine, and lies between
    two languages below ``between`` times the lead, that all but one in a hundred
    training sentences reach. One of fewer than ``letters`` letters is judged
    together with the other short ones of its document.
    """

    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 18
    centroids: int = 4
    sample: int = 300
    agree: float = 0.05
    rounds: int = 8
    reject: float = 0.6
    between: float = 0.3
    letters: int = 12
    batch_characters: int = 250_000


_EDGE = re.compile(r"[^\w]+|\d+|_+")


def letters_only(text: str) -> str:
    """Lower-case words between single spaces, with one at either end."""
    return " " + " ".join(_EDGE.sub(" ", unicodedata.normalize("NFC", text).lower()).split()) + " "


class Centroids:
    """Clustered TF-IDF centroids of each language."""

    def __init__(self, samples: list[tuple[str, str]], settings: Settings):
        self.settings = settings
        self.languages = sorted({lang for lang, _ in samples})
        self.margin = 0.0
        texts = [letters_only(t) for _, t in samples]
        owner, bucket, count = self._counts(texts)
        labels = np.array([self.languages.index(lang) for lang, _ in samples])
        size, kinds = 1 << settings.bits, len(self.languages)
        per = np.bincount(bucket.astype(np.int64) * kinds + labels[owner], minlength=size * kinds).reshape(size, kinds)
        seen = per.sum(axis=1)
        # Share of each language's texts that hold the n-gram; what none holds keeps its whole weight, as a sign of distance.
        rate = np.sort((per + 0.5) / (np.bincount(labels, minlength=kinds) + 1.0), axis=1)
        tells = (rate[:, -1] - rate[:, -2]) / (rate[:, -1] + rate[:, -2]) if kinds > 1 else np.ones(size)
        self.idf = ((np.log((1 + len(texts)) / (1 + seen)) + 1) * np.where(seen > 0, tells, 1.0)).astype(np.float32)
        known = np.flatnonzero(seen)
        self.row = np.full(size, len(known), dtype=np.int32)
        self.row[known] = np.arange(len(known))
        weight = self._weights(bucket, count)
        weight /= np.sqrt(np.maximum(np.bincount(owner, weights=weight * weight, minlength=len(texts)), 1e-9))[owner].astype(np.float32)
        centres, self.owner, near = [], [], []
        for k in range(kinds):
            mine = labels[owner] == k
            found, cosine = self._cluster(owner[mine], self.row[bucket[mine]], weight[mine], len(known))
            near.append(float(np.percentile(cosine, 1)))
            centres += list(found)
            self.owner += [k] * len(found)
        # A row a centroid: the gathers of one centroid stay in a core's cache.
        self.matrix = np.hstack([np.stack(centres), np.zeros((len(centres), 1), dtype=np.float32)]).astype(np.float32)
        self.owner = np.array(self.owner)
        self.least = min(near) * settings.reject

    def _weights(self, bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count.astype(np.float32))) * self.idf[bucket]

    def _cluster(self, owner: np.ndarray, row: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Spherical k-means of the sparse unit vectors (owner, row, weight): centres, and each vector's cosine with its own."""
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        number = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1

        def cosines(centres: np.ndarray) -> np.ndarray:
            return np.stack([np.add.reduceat(c[row] * weight, starts) for c in centres], axis=1)

        def total(part: np.ndarray) -> np.ndarray:
            c = np.bincount(row[part], weights=weight[part], minlength=size).astype(np.float32)
            return c / max(float(np.linalg.norm(c)), 1e-9)

        # Farthest-first seeds.
        centres = total(number == 0)[None]
        while len(centres) < min(self.settings.centroids, len(starts)):
            centres = np.vstack([centres, total(number == cosines(centres).max(axis=1).argmin())])
        for _ in range(self.settings.rounds):
            nearest = cosines(centres).argmax(axis=1)[number]
            centres = np.stack([total(nearest == j) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        return centres, cosines(centres).max(axis=1)

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, occurrences) of every n-gram of the texts, by text."""
        points, owner = codes(texts)
        bits = self.settings.bits
        found = [hashes(points, owner, order, bits) for order in self.settings.orders]
        # Narrow keys sort faster; a batch of sentences fits them.
        narrow = len(texts) <= 1 << (32 - bits)
        keys = np.concatenate([who << bits | bucket for bucket, who in found]).astype(np.uint32 if narrow else np.int64)
        keys.sort()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.r_[starts, len(keys)])
        keys = keys[starts]
        return (keys >> bits).astype(np.int32), (keys & ((1 << bits) - 1)).astype(np.int32), count

    def score(self, texts: list[str], letters: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language or -1 where rejected, lead over the next language, cosine with every language).

        Texts of fewer than ``letters`` letters (those of the settings) are rejected.
        """
        least = self.settings.letters if letters is None else letters
        parts, begin = [(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, len(self.languages))))], 0
        ends = np.cumsum([len(t) for t in texts])
        while begin < len(texts):
            # Blocks of bounded size; a longer text is a block of its own.
            limit = (ends[begin - 1] if begin else 0) + self.settings.batch_characters
            stop = max(begin + 1, int(np.searchsorted(ends, limit, side="right")))
            parts.append(self._score(texts[begin:stop], least))
            begin = stop
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _score(self, texts: list[str], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [letters_only(t) for t in texts]
        owner, bucket, count = self._counts(plain)
        weight = self._weights(bucket, count)
        square = np.bincount(owner, weights=weight * weight, minlength=len(texts))
        row = self.row[bucket]
        cosine = np.zeros((len(texts), len(self.matrix)))
        if len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            cosine[owner[starts]] = np.stack([np.add.reduceat(centre[row] * weight, starts) for centre in self.matrix], axis=1)
        cosine /= np.sqrt(np.maximum(square, 1e-9))[:, None]
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        order = np.sort(best, axis=1)
        lang, top = best.argmax(axis=1), order[:, -1]
        lead = top - order[:, -2] if best.shape[1] > 1 else top
        size = np.fromiter((len(p) - p.count(" ") for p in plain), dtype=np.int64, count=len(plain))
        return np.where((top < self.least) | (size < letters), -1, lang), lead, best

    def document(self, own: list[str], lang: np.ndarray, lead: np.ndarray, best: np.ndarray) -> list[tuple[int, float]]:
        """The segments of a document's scored sentences; where none has a language, that of its short sentences as one text."""
        found = segments(lang, lead, best, self.margin)
        if not found:
            short = " ".join(s for s in own if sum(map(str.isalpha, s)) < self.settings.letters)
            if short:
                k, ahead, cosines = self.score([short], letters=1)
                if k[0] >= 0 and ahead[0] >= self.margin:
                    found = segments(k, ahead, cosines, self.margin)
        return found


_END = re.compile(r"(?<=[.!?;:])[\"'”»)\]]*\s+")
_BREAK = re.compile(r"\r\n|\r|\n| |\x85")


def sentences(text: str) -> list[str]:
    """Sentences of ``text``; a line that goes on in lower case is joined to the one before."""
    joined: list[str] = []
    for line in _BREAK.split(text):
        line = line.strip().lstrip(">•*- \t").strip()
        if not line:
            joined.append("")
        elif joined and joined[-1] and joined[-1][-1] not in ".!?;:" and line[:1].islower():
            joined[-1] += " " + line
        else:
            joined.append(line)
    return [s for line in joined if line for s in _END.split(line) if s.strip()]


def segments(lang: np.ndarray, lead: np.ndarray, best: np.ndarray, margin: float) -> list[tuple[int, float]]:
    """(language, confidence) of the longest runs of sentences in one language.

    A rejected sentence, or one that lies nearly between two languages, belongs
    to the run around it. Where all sentences lie between languages, their mean
    cosines decide. Confidence is the run's mean cosine with its language as a
    share of that with its two nearest languages.
    """
    clear = np.flatnonzero((lang >= 0) & (lead >= margin))
    if not len(clear):
        weak = np.flatnonzero(lang >= 0)
        runs = [(int(best[weak].mean(axis=0).argmax()), weak)] if len(weak) else []
    else:
        cuts = np.flatnonzero(np.diff(lang[clear])) + 1
        runs = [(int(lang[part[0]]), part) for part in np.split(clear, cuts)]
    found = []
    for k, part in runs:
        mean = best[part].mean(axis=0)
        second = np.delete(mean, k).max() if len(mean) > 1 else 0.0
        found.append((k, float(mean[k] / max(mean[k] + second, 1e-9))))
    return found


def label_code(label: Column) -> Column:
    """The two-letter code that a label stands for: case, spaces, region and three-letter forms are dropped."""
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    code = F.create_map(*[F.lit(x) for pair in THREE_LETTERS.items() for x in pair])[head]
    return F.when(F.coalesce(head, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(code, head))


_OUT = T.StructType([T.StructField("doc", T.LongType()), T.StructField("rotulo", T.StringType()), T.StructField("segmento", T.IntegerType()), T.StructField("idioma", T.StringType()), T.StructField("confianca", T.DoubleType()), T.StructField("segmentos", T.IntegerType())])


def fit(samples: DataFrame, documents: DataFrame | None = None, *, language: str = "idioma", text: str = "texto", label: str = "lang", body: str = "text", settings: Settings = Settings()) -> Centroids:
    """Centroids from at most ``settings.sample`` different labelled texts a language, chosen by hash.

    With ``documents``, as many of its documents a label are added: of their
    sentences those for which the first centroids agree with the label, so that
    wrong labels and mixed texts teach nothing. They are used only if centroids
    fitted with them name left-out labelled sentences at least as well.
    """
    first = _bounded(samples, F.col(language), text, settings.sample)
    if not first:
        raise ValueError("no labelled texts to fit languages on")
    centroids = Centroids(first, settings)
    right, margin = held_out(first, [], settings)
    if documents is not None:
        labelled = documents.where(label_code(F.col(label)).isin(centroids.languages))
        more = [(lang, s) for lang, t in _bounded(labelled, label_code(F.col(label)), body, settings.sample) for s in sentences(t)]
        found, lead, _ = centroids.score([s for _, s in more])
        kept = sorted({(lang, s) for (lang, s), k, gap in zip(more, found, lead) if k >= 0 and centroids.languages[k] == lang and gap >= settings.agree})
        right_with, margin_with = held_out(first, kept, settings)
        if kept and right_with >= right:
            centroids, margin = Centroids(first + kept, settings), margin_with
    centroids.margin = margin
    return centroids


def held_out(first: list[tuple[str, str]], more: list[tuple[str, str]], settings: Settings) -> tuple[float, float]:
    """(share of labelled sentences named rightly, margin) by centroids that were fitted on the other half of the labelled texts, and ``more``.

    The margin is what a sentence's lead must reach: ``settings.between`` times
    the lead that all but one in a hundred rightly named sentences have.
    """
    right, leads, asked = 0, [], 0
    for half in (0, 1):
        train, test = ([x for n, x in enumerate(first) if (n % 2 == half) == side] for side in (False, True))
        if not train or not test:
            continue
        model = Centroids(train + more, settings)
        pieces = [(lang, s) for lang, t in test for s in sentences(t)]
        found, lead, _ = model.score([s for _, s in pieces])
        good = [k >= 0 and model.languages[k] == lang for k, (lang, _) in zip(found, pieces)]
        right, asked = right + sum(good), asked + len(good)
        leads += [gap for gap, ok in zip(lead, good) if ok]
    return right / max(asked, 1), settings.between * float(np.percentile(leads, 1)) if leads else 0.0


def _bounded(rows: DataFrame, language: Column, text: str, most: int) -> list[tuple[str, str]]:
    """The first ``most`` different texts of each language by hash; copies count once."""
    usable = rows.where(language.isNotNull() & (F.trim(F.col(text)) != "")).select(language.alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    # Hashes are ranked, not texts: each partition keeps its first ones before any is moved.
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = usable.select("l", "h").distinct().withColumn("p", place).where(F.col("p") <= most).select("l", "h")
    # At most ``most`` hashes a language are broadcast.
    return sorted((r.l, r.t) for r in usable.join(F.broadcast(chosen), ["l", "h"]).select("l", "t").distinct().collect())


def identify(documents: DataFrame, centroids: Centroids, *, id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """One row per segment of every document with text: language, confidence, and the label's code.

    A document without any sentence in a language has the one segment ``und``.
    Null, empty and blank texts give no row; repeated rows each give theirs.
    Whole texts are read, whatever their length.
    """
    spark = documents.sparkSession
    rows = documents.where(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) != "").select(F.col(id).cast("bigint").alias("doc"), F.col(text).alias("text"), label_code(F.col(label)).alias("rotulo"))
    slots = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < slots:
        rows = rows.repartition(slots)
    # The matrix holds only n-grams of the bounded sample.
    carried = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = carried.value
        for batch in batches:
            out, pieces, counts = [], [], []
            for value in batch["text"]:
                own = sentences(value)
                pieces += own
                counts.append(len(own))
            lang, lead, best = model.score(pieces)
            at = 0
            for doc, code, count in zip(batch["doc"], batch["rotulo"], counts):
                own = slice(at, at + count)
                at += count
                found = model.document(pieces[own], lang[own], lead[own], best[own])
                named = [(model.languages[x], c) for x, c in found] or [("und", 1.0)]
                out += [(doc, code, n, name, round(float(c), 4), len(named)) for n, (name, c) in enumerate(named)]
            yield pd.DataFrame(out, columns=_OUT.names)

    return rows.mapInPandas(run, _OUT)


def mislabelled(segments_: DataFrame) -> DataFrame:
    """Segments of documents that mix languages or whose label is missing or wrong."""
    wrong = F.col("rotulo").isNull() | (F.col("rotulo") != F.col("idioma"))
    return segments_.where((F.col("segmentos") > 1) | wrong)
