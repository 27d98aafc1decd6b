"""The deterministic half of routing: reject zone, fallback, limits of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ANSWER = "NAO_SEI"


def decided(simple: Column, threshold: float) -> Column:
    """Label from the probability of SIMPLES: none in the reject zone, SIMPLES on a tie."""
    top = F.greatest(simple, 1 - simple)
    return F.when(top < threshold, "INDETERMINADO").when(simple >= 0.5, "SIMPLES").otherwise("COMPLEXA")


def hard(label: Column, text: Column) -> Column:
    """SIMPLES for blank texts and failed predictions."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "SIMPLES").otherwise(F.coalesce(label, F.lit("SIMPLES")))


def answer_route(answer: Column) -> Column:
    """COMPLEXA where a router's answer names it anywhere, whatever the case; SIMPLES else, also for a call that failed."""
    return F.when(F.coalesce(F.upper(answer).contains("COMPLEXA"), F.lit(False)), "COMPLEXA").otherwise("SIMPLES")


# Extensions of sound and of pictures.
SOUND = ("wav", "mp3", "m4a", "ogg", "webm")
PICTURES = ("png", "jpg", "jpeg", "webp")


def input_status(file: Column, content: Column, text: Column) -> Column:
    """Struct (status, tipo) of a request: 400 without or with both inputs or with an empty file, 415 for a file of no known kind, else 200."""
    has_file, has_text = F.coalesce(file, F.lit("")) != "", F.coalesce(F.trim(text), F.lit("")) != ""
    extension = F.lower(F.regexp_extract(file, r"([^.]*)$", 1))
    kind = F.when(extension.isin(*SOUND), "audio").when(extension.isin(*PICTURES), "imagem")
    status = F.when(has_file == has_text, 400).when(has_text, 200).when(kind.isNull(), 415).when(F.coalesce(F.length(content), F.lit(0)) == 0, 400).otherwise(200)
    return F.struct(status.alias("status"), F.when(status == 200, F.when(has_text, "texto").otherwise(kind)).alias("tipo"))


def with_fallback(primary: Column, secondary: Column) -> Column:
    """Struct (resposta, fallback, erros): the first answer that is not blank, else the mark of no answer."""
    first, second = F.nullif(F.trim(primary), F.lit("")), F.nullif(F.trim(secondary), F.lit(""))
    errors = F.array_compact(F.array(F.when(first.isNull(), "principal vazio"), F.when(first.isNull() & second.isNull(), "reserva vazia")))
    return F.struct(F.coalesce(first, second, F.lit(NO_ANSWER)).alias("resposta"), first.isNull().alias("fallback"), errors.alias("erros"))


def client_key(forwarded: Column, peer: Column) -> Column:
    """The first forwarded address, else the peer's."""
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)


def limit_group(path: Column) -> Column:
    """Struct (grupo, quantidade, periodo) of a request path."""
    chat = path.startswith("/chat")
    return F.struct(F.when(chat, "chat").otherwise("geral").alias("grupo"), F.when(chat, 4).otherwise(300).alias("quantidade"), F.lit(60.0).alias("periodo"))


def cost(prompt: Column, completion: Column, prompt_price: float = 0.27, completion_price: float = 1.10) -> Column:
    """Dollars for tokens at prices a million."""
    return prompt * prompt_price / 1e6 + completion * completion_price / 1e6
