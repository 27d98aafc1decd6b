"""Defective prompt and response pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.grams import codes, hashes
from lavra.llm.languages import letters_only
from lavra.llm.truncation import end_likelihoods

# What stands for no answer, after trimming and lower-casing.
PLACEHOLDERS = ("n/d", "n.d.", "nd", "n/a", "n.a.", "na", "nan", "null", "none", "nil", "undefined", "tbd", "todo", "vazio", "(vazio)", "(vazia)", "sem resposta", "(sem resposta)", "[sem resposta]", "<sem resposta>", "em branco", "(em branco)", "pendente", "a definir", "a preencher", "xxx", "resposta:", "resposta")

# Sentences that decline or claim not to know, without accents.
REFUSALS = (
    r"\bnao[_ ]sei\b(?! (que|se|de que)\b)",
    r"\bnao (posso|consigo|devo|poderei|irei|vou|e possivel|foi possivel|estou (autorizad[oa]|apt[oa]|em condicoes)( a| de| para)?|sou capaz de|tenho (como|condicoes de)|me e possivel) (te |lhe |o |a )?(ajudar|responder|atender|opinar|auxiliar|tratar|comentar|fornecer|dizer|informar|discutir|colaborar|cumprir)",
    r"\bnao (tenho|ha|encontrei|existem?|disponho de|localizei|possuo|achei|constam?|identifiquei)( \w+)? (informac\w+|dados|elementos|conteudo|conhecimento|evidencias?|resposta|permissao|autorizacao|base|nos trechos|no material|nos documentos)\b(?! (de )?que\b)",
    r"\b(desculpe|desculpa|lamento|sinto muito|infelizmente|perdao)\b.{0,60}\b(nao|prefiro|foge|fora|impossivel)\b",
    r"\b(lamento|sinto muito)\b",
    r"\b(essa|esta) (pergunta|questao|solicitacao) (foge|esta fora|nao (esta|pode))",
    r"\brecuso-me\b|\bme recuso\b|\bprefiro nao (opinar|responder|comentar)",
    r"\bcomo (um |uma )?(assistente|modelo de linguagem|inteligencia artificial|ia\b)",
    r"\b(i am|i.m) (sorry|unable|not able|afraid)\b|\bunable to (answer|help|assist)|\bi (can ?not|can.t|do not|don.t|am not able to) (help|answer|assist|know|have|provide)",
    r"\bas an? (ai|language model|assistant)\b",
    r"\b(lo siento|no puedo (ayudar|responder)|no tengo (informacion|suficiente)|no lo se)\b",
    r"\b(je suis desole|je ne (peux|sais) pas|non lo so|mi dispiace|non posso (aiutar|risponder)|es tut mir leid|ich (kann|weiss) (das |es )?nicht)\b",
)


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts of a language that the Bayes model is trained on.

    Languages are taken as different where the answer's own language is ahead of
    the question's by ``ahead`` nats, the question's of the answer's by
    ``question_ahead``; if either has n < ``words`` words, by ``words`` / n times as
    much, as a term of another language tells little.
    """

    orders: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 17
    sample: int = 500
    words: int = 4
    ahead: float = 8.0
    question_ahead: float = 4.0


class NaiveBayes:
    """Languages by character n-grams with add-half smoothing."""

    def __init__(self, samples: list[tuple[str, str]], settings: Settings):
        self.settings = settings
        self.languages = sorted({lang for lang, _ in samples})
        texts = [letters_only(t) for _, t in samples]
        label = np.array([self.languages.index(lang) for lang, _ in samples])
        size = 1 << settings.bits
        counts = np.full((size, len(self.languages)), 0.5)
        for bucket, owner in self._grams(texts):
            np.add.at(counts, (bucket, label[owner]), 1)
        # A row a language: its gathers stay in a core's cache.
        self.weights = np.ascontiguousarray((np.log(counts) - np.log(counts.sum(axis=0))).T)

    def _grams(self, texts: list[str]):
        points, owner = codes(texts)
        for order in self.settings.orders:
            yield hashes(points, owner, order, self.settings.bits)

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of every text in every language; the n-grams of one word count once in effect."""
        plain = [letters_only(t or "") for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        for bucket, owner in self._grams(plain):
            if len(owner):
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                for k, weights in enumerate(self.weights):
                    total[owner[starts], k] += np.add.reduceat(weights[bucket], starts)
        # Overlapping n-grams repeat the same evidence once for every order.
        return total / len(self.settings.orders)


def train(samples: DataFrame, *, language: str = "idioma", text: str = "texto", settings: Settings = Settings()) -> NaiveBayes:
    """A model from at most ``settings.sample`` labelled texts a language, chosen by hash."""
    usable = samples.where(F.col(language).isNotNull() & (F.trim(F.col(text)) != "")).select(F.col(language).alias("l"), F.col(text).alias("t"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("t"), "t"))
    rows = usable.withColumn("p", place).where(F.col("p") <= settings.sample).collect()
    return NaiveBayes(sorted((r.l, r.t) for r in rows), settings)


def unaccented(text: Column) -> Column:
    """Lower case with plain letters for the accented ones of the six languages, composed or not."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), "áàâãäåéèêëíìîïóòôõöúùûüçñ’", "aaaaaaeeeeiiiiooooouuuucn'")


def is_empty(answer: Column) -> Column:
    """Null, blank, without letter or digit, or nothing but a placeholder."""
    return answer.isNull() | ~answer.rlike(r"[\p{L}\p{N}]") | F.lower(F.trim(F.regexp_replace(answer, r"[\s\x{200b}\x{feff}]+", " "))).isin(*PLACEHOLDERS)


def is_refusal(answer: Column) -> Column:
    """Any sentence that declines or claims not to know."""
    return _declines(unaccented(answer))


def _declines(plain: Column) -> Column:
    return plain.rlike("(?s)" + "|".join(f"(?:{p})" for p in REFUSALS))


# Words that label a repeated question.
LABELS = ("pergunta", "questao", "resposta", "a", "e", "question", "answer", "voce", "perguntou")


def is_copy(question: Column, answer: Column) -> Column:
    """The answer holds the question's words and, besides labels, no others."""
    return _repeats(_bag(unaccented(question)), _bag(unaccented(answer)))


def _bag(plain: Column) -> Column:
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), 0)


def _repeats(q: Column, a: Column) -> Column:
    labels = F.array(*[F.lit(w) for w in LABELS])
    new = F.array_except(a, F.concat(q, labels))
    gone = F.array_except(q, F.concat(a, labels))
    return (F.size(q) > 2) & (F.size(a) <= F.size(q) + 4) & (F.size(new) == 0) & (F.size(gone) * 10 <= F.size(q))


_COMPARED = "id bigint, lingua_pergunta string, lingua_resposta string, adiante_pergunta double, adiante_resposta double, palavras int"


def languages(pairs: DataFrame, model: NaiveBayes, *, id: str = "id", question: str = "pergunta", answer: str = "resposta") -> DataFrame:
    """Most likely language of question and answer.

    ``adiante_resposta`` is by how much the answer's language is likelier for the
    answer than the question's language is; ``adiante_pergunta`` the other way round;
    ``palavras`` the words of the shorter of both.
    """
    rows = pairs.where(F.col(question).isNotNull() & F.col(answer).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"))
    slots = pairs.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < slots:
        rows = rows.repartition(slots)
    # A table of n-gram weights of fixed size: 2**bits x languages.
    carried = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = carried.value
        names = np.array(m.languages)
        for batch in batches:
            q, a = m.log_likelihoods(batch["q"].tolist()), m.log_likelihoods(batch["a"].tolist())
            i, k, n = q.argmax(axis=1), a.argmax(axis=1), np.arange(len(batch))
            yield pd.DataFrame({"id": batch["id"], "lingua_pergunta": names[i], "lingua_resposta": names[k], "adiante_pergunta": q[n, i] - q[n, k], "adiante_resposta": a[n, k] - a[n, i], "palavras": [min(len(letters_only(x).split()), len(letters_only(y).split())) for x, y in zip(batch["q"], batch["a"])]})

    return rows.mapInPandas(run, _COMPARED)


def defects(pairs: DataFrame, model: NaiveBayes, *, id: str = "id", question: str = "pergunta", answer: str = "resposta", kind: str = "tipo", source: str = "origem", settings: Settings = Settings()) -> DataFrame:
    """(id, defeito) of every defective pair; a pair may have several defects, each once.

    ``vazia``: no answer; ``recusa``: declines in a row whose kind is not
    ``abstencao``; ``copia``: gives back the question and nothing more;
    ``truncada``: ends before the answer does; ``idioma``: in another language
    than the question. An empty answer has no other defect. Null questions are
    never copied and have no language; null kinds count as not ``abstencao``.
    """
    rows = pairs.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"), F.coalesce(F.col(kind), F.lit("")).alias("k"), F.col(source).alias("s"))
    empty = is_empty(F.col("a"))
    # Folded once, for all that is asked of the words; an outer explode asks nothing twice.
    folded = rows.withColumn("ua", unaccented(F.col("a"))).withColumn("uq", unaccented(F.col("q"))).withColumn("vazia", empty)
    labels = F.array_compact(
        F.array(
            F.when(F.col("vazia"), F.lit("vazia")),
            F.when(~F.col("vazia") & (F.lower(F.trim("k")) != "abstencao") & _declines(F.col("ua")), F.lit("recusa")),
            F.when(~F.col("vazia") & F.coalesce(_repeats(_bag(F.col("uq")), _bag(F.col("ua"))), F.lit(False)), F.lit("copia")),
        )
    )
    plain = folded.select("id", F.explode_outer(labels).alias("defeito")).where("defeito IS NOT NULL")
    full = rows.where(~empty)
    texts = full.select(F.lit("pares").alias("tabela"), F.col("id").alias("registro"), F.col("s").alias("fonte"), F.col("a").alias("texto"), F.col("q").alias("pergunta"))
    cut = end_likelihoods(texts).where("cortado").select(F.col("registro").alias("id"), F.lit("truncada").alias("defeito"))
    factor = F.greatest(F.lit(1.0), F.lit(float(settings.words)) / F.greatest(F.col("palavras"), F.lit(1)))
    other = languages(full, model, question="q", answer="a").where((F.col("adiante_resposta") >= settings.ahead * factor) & (F.col("adiante_pergunta") >= settings.question_ahead * factor)).select("id", F.lit("idioma").alias("defeito"))
    return plain.unionByName(cut).unionByName(other).distinct()
