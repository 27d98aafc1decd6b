"""Repair of text from scanned pages.

Lines are told apart first: printed page numbers by their dress and their
distance from the physical page, running headers and footers by an averaged
perceptron over position, shape and recurrence in the document. The rest is
running text, whose distinct words go through an averaged-perceptron character
editor (keep, replace, delete, insert, and join over a line end). A word that
the editor proposes is taken when the corpus knows it better than what was read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lavra.llm.perceptron import Perceptron

#: Stands for the line end inside a word that was split over two lines.
JOIN = "\u0001"


@dataclass(frozen=True)
class Settings:
    """``lines`` and ``words`` bound the samples that the two perceptrons are trained on.

    A line recurs when ``recurs`` different texts of its document, and a share
    of ``rate`` of them, hold it. A proposed word must be ``better`` times as
    frequent as the one read. ``known`` is the share of texts from which a word is
    ordinary. ``beam`` candidates of at most ``edits`` changed places are kept for a word, and ``singles`` of one.
    """

    lines: int = 12_000
    cleaning: int = 2
    words: int = 12_000
    recurs: int = 3
    rate: float = 0.01
    near_page: int = 10
    better: int = 8
    known: float = 0.0005
    beam: int = 8
    singles: int = 24
    edits: int = 3


# Dresses of a printed page number.
_PAGE = r"(?i)^[^\p{L}\p{N}]*(?:(?:p[áaÁ@]gina|p[áaÁ]g|pg|page|p|folha|fls?|f)\.?\s*)?(\d{1,6})(?:\s*(?:de|/|of|-)\s*\d{1,6})?[^\p{L}\p{N}]*$"
_DRESSED = r"[^\d\s]"
_VALUE = r"\d[.,]\d|=|%"
# How a page number is set beside a running header.
_BESIDE = (r"^\d{1,6}\s*[|·–—-]\s+", r"\s*(?:\.{2,}|…|[|·–—])\s*\d{1,6}$")
_SECTION = r"^\d+(\.\d+)+\.?\s+\p{L}"


_BLANK = r"[ \t\x0b\f\r\x{feff}]*"


def _split(chunks: DataFrame, id: str, document: str, page: str, text: str) -> DataFrame:
    """(chunk, doc, pagina, texto_id, l): the trimmed lines of every text, blank ones as ''."""
    # Line ends and the blanks around them are made one sign for the whole text at once.
    flat = F.regexp_replace(F.translate(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\r", "\n"), _BLANK + r"\n" + _BLANK, "\n")
    return chunks.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).cast("int").alias("chunk"), F.coalesce(F.col(document), F.lit("")).alias("doc"), F.coalesce(F.col(page), F.lit(0)).alias("pagina"), F.xxhash64(text).alias("texto_id"), F.split(F.regexp_replace(flat, rf"^{_BLANK}|{_BLANK}\z", ""), "\n", -1).alias("l"))


def lines(chunks: DataFrame, *, id: str = "id", document: str = "doc_id", page: str = "pagina", text: str = "texto") -> DataFrame:
    """(chunk, doc, pagina, texto_id, pos, linha) of every line, trimmed; blank ones are kept as ''."""
    return _split(chunks, id, document, page, text).select("chunk", "doc", "pagina", "texto_id", F.posexplode("l").alias("pos", "linha"))


def shown_lines(chunks: DataFrame, *, id: str = "id", document: str = "doc_id", page: str = "pagina", text: str = "texto") -> DataFrame:
    """As :func:`lines` without blank ones, with the line before and after, the place among them and their number; nothing is moved for it."""
    placed = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("pos"), x.alias("linha"))), lambda s: s["linha"] != "")
    rows = _split(chunks, id, document, page, text).select("chunk", "doc", "pagina", "texto_id", placed.alias("s")).where(F.size("s") > 0)
    none, n = F.array(F.lit(None).cast("string")), F.size("s")
    zipped = F.arrays_zip(F.col("s.pos").alias("pos"), F.col("s.linha").alias("linha"), F.concat(none, F.slice("s.linha", F.lit(1), n - 1)).alias("antes"), F.concat(F.slice("s.linha", F.lit(2), n - 1), none).alias("depois"))
    return rows.select("chunk", "doc", "pagina", "texto_id", n.alias("linhas"), F.posexplode(zipped).alias("ordem", "z")).select("chunk", "doc", "pagina", "texto_id", "linhas", "ordem", "z.pos", "z.linha", "z.antes", "z.depois")


def page_number(line: Column) -> Column:
    """The number of a line that holds nothing but a page number; else null."""
    found = F.regexp_extract(line, _PAGE, 1)
    return F.when((found != "") & ~line.rlike(_VALUE), F.try_to_number(found, F.lit("999999")).cast("int"))


def line_key(line: Column) -> Column:
    """What a running line keeps from page to page: without its page number, folded, look-alike characters as letters."""
    key = F.lower(line)
    for pattern in _BESIDE:
        key = F.regexp_replace(key, pattern, "")
    key = F.regexp_replace(F.translate(key, "@", "a"), r"(?<=\p{L})0|0(?=\p{L})", "o")
    key = F.regexp_replace(key, r"(?<=\p{L})[1|](?=\p{L})", "l")
    key = F.translate(F.regexp_replace(key, r"\p{M}+|~", ""), "áàâãäåéèêëíìîïóòôõöúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn")
    return F.trim(F.regexp_replace(key, r"\s+", " "))


def line_features(line: str, key: str, pos: int, total: int, before: str, after: str, times: int, texts: int) -> list[str]:
    """Shape, place and recurrence of a line."""
    found = ["bias"]
    head = re.sub(r"^\d{1,6}\s*[|·–—-]\s+", "", line)
    core = re.sub(r"\s*(?:\.{2,}|…)\s*\d{1,6}$", "", head)
    found += ["num_front"] * (head != line) + ["num_back"] * (core != head)
    tokens = key.split()
    found += [f"w:{re.sub(chr(92) + 'd+', '#', t)}" for t in tokens]
    found += [f"b:{re.sub(chr(92) + 'd+', '#', a)}_{re.sub(chr(92) + 'd+', '#', b)}" for a, b in zip(tokens, tokens[1:])]
    found += [f"sep:{c}" for c in "|·–—()" if c in core] + ["sep: - "] * (" - " in core)
    letters = [c for c in core if c.isalpha()]
    found.append("caps" if letters and all(c.isupper() for c in letters) else "title" if core[:1].isupper() and all(w[:1].isupper() for w in core.split() if len(w) > 3 and w[:1].isalpha()) else "lower" if core[:1].islower() else "mixed")
    shape = found[-1]
    found.append(f"n:{min(len(tokens), 8)}")
    if tokens:
        found += [f"head:{tokens[0]}_{shape}_{min(len(tokens), 8)}", f"tail:{tokens[-1]}_{shape}_{min(len(tokens), 8)}"]
    found.append("first" if pos == 0 else "second" if pos == 1 else "last" if pos == total - 1 else "last_but" if pos == total - 2 else "inside")
    found.append("before:" + ("none" if not before else "end" if before[-1] in ".!?:" else "open"))
    found.append("after:" + ("none" if not after else "low" if after[:1].islower() else "up"))
    found.append(f"times:{min(times, 6)}")
    found.append("rate:" + ("high" if times >= 2 and times * 50 >= texts else "mid" if times >= 2 and times * 200 >= texts else "low"))
    return found


# How a line that is no running line ends, begins, and what a figure's text holds.
_ENDS, _BEGINS, _FIGURE = (".", ",", ";", "!", "?"), r"^[-•*]\s", "FIGURA:"


def _candidates(shown: DataFrame) -> DataFrame:
    """Lines with their page number, and whether they may be a running line, which has a key."""
    letters = F.length(F.regexp_replace("linha", r"\P{L}", ""))
    # What costs least is asked first.
    line = F.col("linha")
    candidate = (F.length(line) <= 90) & ~F.right(line, F.lit(1)).isin(*_ENDS) & ~line.contains(_FIGURE) & ~line.rlike(_BEGINS) & ~line.rlike(_SECTION) & (F.size(F.split(line, r"\s+")) <= 10) & (letters >= 3)
    shown = shown.withColumn("numero", page_number(F.col("linha")))
    return shown.withColumn("candidata", F.col("numero").isNull() & candidate).withColumn("chave", F.when(F.col("candidata"), line_key(F.col("linha"))))


#: Rows up to which statistics of documents and running lines are broadcast.
_BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, stored, as a broadcast side if it has few rows; beyond, as it is."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


@dataclass
class Recurrence:
    """How often running lines and page offsets recur: per document and key, and per document."""

    keys: DataFrame
    documents: DataFrame


def recurrence(chunks: DataFrame, marked: DataFrame, settings: Settings, keep) -> Recurrence:
    """Texts that hold a line's key (those of one text are left out), texts of a document, and its usual page offset. Equal texts under several ids are one text."""
    times = marked.where("candidata").select("doc", "chave", "texto_id").distinct().groupBy("doc", "chave").agg(F.count("*").cast("int").alias("vezes")).where("vezes > 1")
    texts = chunks.groupBy("doc").agg(F.count_distinct("texto_id").cast("int").alias("textos"))
    off = F.col("numero") - F.col("pagina")
    offsets = marked.where(F.abs(off) <= settings.near_page).groupBy("doc", off.alias("desvio")).agg(F.count("*").alias("n")).groupBy("doc").agg(F.max_by("desvio", F.struct("n", -F.abs("desvio"))).alias("desvio"))
    return Recurrence(_small(keep(times)), _small(keep(texts.join(offsets, "doc", "left"))))


def described(marked: DataFrame, found: Recurrence) -> DataFrame:
    """Lines with the recurrence of their key and the statistics of their document."""
    return marked.join(found.keys, ["doc", "chave"], "left").join(found.documents, "doc", "left").withColumn("vezes", F.when(F.col("candidata"), F.coalesce("vezes", F.lit(1))))


def train_lines(described_: DataFrame, settings: Settings = Settings()) -> Perceptron:
    """A perceptron from lines that recur in their document against lines that stand once inside sentences."""
    many = (F.col("vezes") >= settings.recurs) & (F.col("vezes") >= F.col("textos") * settings.rate)
    once = (F.col("vezes") <= 1) & (F.col("linhas") > 1)
    label = F.when(many, "cabecalho").when(once, "corpo")
    place = F.row_number().over(Window.partitionBy("rotulo").orderBy(F.xxhash64("chunk", "pos")))
    rows = described_.where("candidata").withColumn("rotulo", label).where(F.col("rotulo").isNotNull()).withColumn("posto", place).where(F.col("posto") <= settings.lines // 2)
    sample = rows.select("linha", "chave", "ordem", "linhas", "antes", "depois", "vezes", "textos", "rotulo").collect()
    examples = [(line_features(r.linha, r.chave, r.ordem, r.linhas, r.antes or "", r.depois or "", r.vezes, r.textos), r.rotulo) for r in sorted(sample, key=tuple_key)]
    # By shape and place alone, some of the lines seen once are headers: they teach nothing as body lines.
    for _ in range(settings.cleaning):
        shapes = [([f for f in fs if not f.startswith(("times:", "rate:"))], label) for fs, label in examples]
        by_shape = Perceptron(["cabecalho", "corpo"]).train(shapes, rounds=3)
        examples = [x for x, (fs, label) in zip(examples, shapes) if label == "cabecalho" or by_shape.predict(fs) == "corpo"]
    # Every example also stands without its recurrence, so that a header seen once is known by its shape.
    examples += [([f for f in fs if not f.startswith(("times:", "rate:"))], label) for fs, label in examples]
    return Perceptron(["cabecalho", "corpo"]).train(examples)


def tuple_key(row) -> tuple:
    return tuple("" if v is None else str(v) for v in row)


def classified(described_: DataFrame, model: Perceptron, settings: Settings = Settings()) -> DataFrame:
    """(chunk, doc, texto_id, pos, linha, classe): ``pagina``, ``cabecalho`` or ``corpo``."""
    carried = described_.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("boolean")
    def is_header(line: pd.Series, key: pd.Series, pos: pd.Series, total: pd.Series, before: pd.Series, after: pd.Series, times: pd.Series, texts: pd.Series) -> pd.Series:
        m = carried.value

        def one(a, k, b, c, d, e, f, g) -> bool:
            features = line_features(a, k, int(b), int(c), d or "", e or "", int(f or 0), int(g or 1))
            # Recurrence can speak for a header, not against one that its shape and place give away.
            return m.predict(features) == "cabecalho" or m.predict([x for x in features if not x.startswith(("times:", "rate:"))]) == "cabecalho"

        return pd.Series([k is not None and one(a, k, b, c, d, e, f, g) for a, k, b, c, d, e, f, g in zip(line, key, pos, total, before, after, times, texts)], dtype=bool)

    off = F.col("numero") - F.col("pagina") - F.coalesce("desvio", F.lit(0))
    bare = ~F.col("linha").rlike(_DRESSED)
    page = F.col("numero").isNotNull() & (~bare | (F.abs(off) <= F.when(F.col("desvio").isNull(), settings.near_page).otherwise(2)))
    header = is_header("linha", "chave", "ordem", "linhas", "antes", "depois", F.coalesce("vezes", F.lit(0)), F.coalesce("textos", F.lit(1)))
    # The model is asked for candidate lines only.
    asked = described_.where("candidata").withColumn("classe", F.when(header, "cabecalho").otherwise("corpo"))
    rest = described_.where("NOT candidata").withColumn("classe", F.when(page, "pagina").otherwise("corpo"))
    keep = ["chunk", "doc", "texto_id", "pos", "linha", "classe"]
    return asked.select(*keep).unionByName(rest.select(*keep))


def running_text(chunks: DataFrame, furniture: DataFrame, *, id: str = "id", document: str = "doc_id", page: str = "pagina", text: str = "texto") -> DataFrame:
    """(chunk, corpo): every text without blank lines and furniture, split words marked by :data:`JOIN`; texts lie by chunk afterwards."""
    taken = furniture.groupBy("chunk").agg(F.collect_set("pos").alias("fora"))
    rows = _split(chunks, id, document, page, text).select("chunk", "l").join(taken, "chunk", "left")
    body = F.filter("l", lambda x, i: (x != "") & ~F.coalesce(F.array_contains("fora", i), F.lit(False)))
    joined = rows.select("chunk", F.array_join(body, "\n").alias("corpo")).where("corpo <> ''")
    return joined.withColumn("corpo", F.regexp_replace("corpo", r"(?<=\p{L})[-\x{2010}\x{2011}\x{00ac}\x{00ad}]\n(?=\p{Ll})", JOIN))


_OUTER = r"^[^\p{L}\p{N}@|" + JOIN + r"]+|[^\p{L}\p{N}@|~´`^¨" + JOIN + r"]+$"


def words(text: DataFrame) -> DataFrame:
    """(chunk, palavra, vezes, nomes) of every different word of the running text; ``nomes`` counts where it has a capital inside a sentence."""
    tokens = text.select("chunk", F.split("corpo", r"\s+").alias("t")).select("chunk", F.posexplode(F.arrays_zip(F.col("t").alias("atual"), F.concat(F.array(F.lit(".")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(1)))).alias("anterior"))).alias("n", "par"))
    word = F.regexp_replace(F.col("par.atual"), _OUTER, "")
    mid = ~F.coalesce(F.col("par.anterior"), F.lit(".")).rlike(r"[.!?:|]$")
    said = tokens.select("chunk", F.lower(word).alias("palavra"), (mid & word.rlike(r"^\p{Lu}")).alias("nome")).where(F.length("palavra") > 1)
    # The running text lies by chunk already, so nothing is moved here.
    return said.groupBy("chunk", "palavra").agg(F.count("*").alias("vezes"), F.count_if("nome").alias("nomes"))


def counts(words_: DataFrame) -> DataFrame:
    """(palavra, n, nome) of every distinct word: chunks that hold it, share of capitals inside sentences."""
    return words_.groupBy("palavra").agg(F.count("*").alias("n"), (F.sum("nomes") / F.sum("vezes")).alias("nome"))


def char_features(word: str, at: int) -> list[str]:
    """The character and its neighbours."""
    padded = "^^" + word + "$$"
    c = padded[at + 2]
    l1, l2, r1, r2 = padded[at + 1], padded[at], padded[at + 3], padded[at + 4]
    odd = not c.isalpha() and c not in "-'"
    return ["bias", f"c:{c}", f"cl:{l1}{c}", f"cr:{c}{r1}", f"lcr:{l1}{c}{r1}", f"llc:{l2}{l1}{c}", f"crr:{c}{r1}{r2}", f"llcrr:{l2}{l1}{c}{r1}{r2}", f"odd:{odd}"]


def labels_of(read: str, right: str) -> list[str] | None:
    """The operation at every character of ``read`` that makes it ``right``, where they differ in one short place."""
    i = 0
    while i < min(len(read), len(right)) and read[i] == right[i]:
        i += 1
    j = 0
    while j < min(len(read), len(right)) - i and read[-1 - j] == right[-1 - j]:
        j += 1
    old, new = read[i : len(read) - j], right[i : len(right) - j]
    if not old and new and i > 0:
        i, old, new = i - 1, read[i - 1], read[i - 1] + new
    if not 1 <= len(old) <= 2 or len(new) > 2:
        return None
    labels = ["="] * len(read)
    labels[i] = f"r:{new}" if new else "-"
    if len(old) == 2:
        labels[i + 1] = "-"
    return labels


def train_editor(counts_: DataFrame, settings: Settings = Settings()) -> Perceptron:
    """An editor from rare words that lie one short edit beside a frequent one, and from the frequent ones themselves."""
    frequent = counts_.where(~F.col("palavra").contains(JOIN) & F.col("palavra").rlike(r"^[\p{L}'-]+$")).orderBy(F.desc("n"), "palavra").limit(settings.words // 2).collect()
    top = frequent[0]["n"] if frequent else 0
    good = {r.palavra: r.n for r in frequent if r.n * 2000 >= top and r.n >= 4 and (r.nome or 0) <= 0.5}
    least = min(good.values(), default=1)
    rare = counts_.where((F.col("n") * settings.better <= max(least * 4, 8)) & (F.coalesce("nome", F.lit(0.0)) <= 0.5)).orderBy(F.xxhash64("palavra")).limit(settings.words).collect()
    near: dict[tuple[str, str, int], list[str]] = {}
    for word in good:
        for i in range(len(word) + 1):
            for cut in (0, 1, 2):
                if i + cut <= len(word):
                    near.setdefault((word[:i], word[i + cut :], cut), []).append(word)
    examples, kinds = [], {"=": 0}
    for row in rare:
        read = row.palavra
        if read in good:
            continue
        best = None
        for i in range(len(read)):
            for cut in (1, 2):
                if i + cut > len(read):
                    continue
                for kept in (0, 1, 2):
                    if cut == 2 and kept == 2:
                        continue
                    for word in near.get((read[:i], read[i + cut :], kept), ()):
                        if good[word] >= settings.better * row.n and (best is None or (cut + kept, -good[word]) < best[0]):
                            best = ((cut + kept, -good[word]), word)
        labels = best and labels_of(read, best[1])
        if labels:
            for at, label in enumerate(labels):
                examples.append((char_features(read, at), label))
                kinds[label] = kinds.get(label, 0) + (label != "=")
    for word in good:
        examples += [(char_features(word, at), "=") for at in range(len(word))]
    # Operations seen once or twice are chance neighbours.
    usual = {k for k, n in kinds.items() if n >= 3} | {"=", "-", "r:-"}
    examples = [(f, label) for f, label in examples if label in usual]
    return Perceptron(usual).train(examples, rounds=4)


# Spacing accents and the combining ones they stand for.
_ACCENTS = str.maketrans({"~": "\u0303", "´": "\u0301", "`": "\u0300", "^": "\u0302", "¨": "\u0308"})


def composed(word: str) -> str:
    """``word`` with accents that were read as characters of their own set on their letters."""
    return unicodedata.normalize("NFKC", word.translate(_ACCENTS))


def proposals(word: str, editor: Perceptron, settings: Settings) -> list[tuple[str, float]]:
    """Words that the editor would make of ``word``, best first, with their scores against leaving it."""
    states: list[tuple[float, int, str, bool]] = [(0.0, 0, "", False)]
    single: list[tuple[float, str]] = []
    for at, c in enumerate(word):
        scores = editor.scores(char_features(word, at))
        keep = scores["="]
        must = c == JOIN
        options = sorted(((s - keep, label) for label, s in scores.items() if label != "=" and (s - keep > -60 or must)), reverse=True)[:8]
        if must:
            options = [(scores["-"] - keep, "-"), (scores["r:-"] - keep, "r:-")]
        if not must and JOIN not in word:
            # Each place alone as well, so that no better-looking double change crowds a single one out.
            for more, label in options:
                if label != "-":
                    single += [(more, word[:at] + label[2:] + word[at + 1 :]), (more, word[:at] + label[2:] + word[at + 2 :])]
        fresh = []
        for gain, changed, made, open_ in states:
            if not must:
                fresh.append((gain, changed, made + c, False))
            for more, label in options:
                if label == "-":
                    # A character goes after its neighbour took its place, or as a line end.
                    if must or open_ or more > 0:
                        fresh.append((gain + more, changed + (not must and not open_), made, False))
                elif changed < settings.edits:
                    fresh.append((gain + more, changed + (not must), made + label[2:], True))
        states = sorted(fresh, key=lambda s: -s[0])[: settings.beam * 3]
    seen: dict[str, float] = {}
    for gain, _, made, _ in states:
        if made != word and made and made not in seen:
            seen[made] = gain
    best = sorted(seen.items(), key=lambda x: -x[1])[: settings.beam]
    alone = sorted({made: gain for gain, made in sorted(single) if made not in seen and made != word}.items(), key=lambda x: -x[1])
    return best + alone[: settings.singles]


def corrections(counts_: DataFrame, editor: Perceptron, settings: Settings = Settings()) -> DataFrame:
    """(palavra, certa, juntada): the right word for every distinct word that was misread or split.

    Every distinct rare word goes through the editor; of its proposals the one
    that the corpus holds most often is taken if it is ``better`` times as
    frequent as what was read. A split word that no proposal completes is joined.
    A name with figures or signs among its letters is put right even where it
    stands nowhere else.
    """
    spark = counts_.sparkSession
    carried = spark.sparkContext.broadcast(editor)  # bounded by the sample
    odd = F.col("palavra").rlike(r"\p{L}.*[0-9@|~´`¨^,]|[0-9@|~].*\p{L}")
    # What is frequent and made of letters alone needs no editing.
    asked = counts_.where(F.col("palavra").rlike(r"\p{L}"))
    slots = spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = carried.value
        for batch in batches:
            rows = []
            for word in batch["palavra"]:
                if 2 < len(word) <= 60:
                    rows += [(word, made, float(gain), k) for k, (made, gain) in enumerate(proposals(word, m, settings))]
                if composed(word) != word:
                    rows.append((word, composed(word), 0.0, 90))
                if JOIN in word:
                    rows += [(word, word.replace(JOIN, ""), -50.0, 98), (word, word.replace(JOIN, "-"), -51.0, 99)]
            yield pd.DataFrame(rows, columns=["palavra", "certa", "ganho", "posto"])

    top = counts_.agg(F.max("n").alias("maior"))
    rare = asked.join(F.broadcast(top)).where(F.col("palavra").contains(JOIN) | (F.col("n") * settings.better <= F.col("maior") * 0.2)).select("palavra")
    made = rare.repartition(slots).mapInPandas(run, "palavra string, certa string, ganho double, posto int")
    known = counts_.select(F.col("palavra").alias("certa"), F.col("n").alias("n_certa"))
    both = made.join(counts_, "palavra").join(known, "certa", "left").withColumn("n_certa", F.coalesce("n_certa", F.lit(0))).withColumn("estranha", odd)
    split = F.col("palavra").contains(JOIN)
    name = F.coalesce("nome", F.lit(0.0)) > 0.5
    fine = F.col("certa").rlike(r"^[\p{L}][\p{L}'-]*[\p{L}]$")
    enough = (F.col("n_certa") >= settings.better * F.col("n")) | (name & (F.col("n_certa") > F.col("n"))) | (F.col("estranha") & (F.col("n_certa") > 0) & fine & (F.length("palavra") > 4))
    lone = F.col("estranha") & name & (F.col("posto") == 0) & (F.col("n_certa") == 0) & fine & ~F.col("palavra").rlike(r"\d{2}")
    taken = both.where(fine & F.when(split, F.lit(True)).otherwise(enough | lone))
    order = Window.partitionBy("palavra").orderBy(F.desc(F.when(F.col("n_certa") > 0, 1).otherwise(0)), F.desc(F.log(1 + F.col("n_certa")) * 2 + F.col("ganho") / 4), "certa")
    best = taken.withColumn("lugar", F.row_number().over(order)).where("lugar = 1")
    plain = F.regexp_replace("palavra", JOIN, "")
    misread = F.when(split, (plain != F.regexp_replace("certa", "-", "")) & (F.regexp_replace(plain, "-", "") != F.regexp_replace("certa", "-", ""))).otherwise(F.lit(True))
    return best.select("palavra", "certa", split.alias("juntada"), misread.alias("lida_errada"))


@dataclass
class Repair:
    """What was found in a table of chunks; ``lines`` are those that are furniture."""

    lines: DataFrame
    text: DataFrame
    words: DataFrame
    corrections: DataFrame


def repair(chunks: DataFrame, settings: Settings = Settings(), keep=lambda df: df) -> Repair:
    """Lines with their class, running text and corrections of all chunks.

    Null and blank texts have none of them; repeated texts are each repaired but
    count once where lines recur. A null document is one document of its own, a
    null page page 0. ``keep`` stores an intermediate result that is used often.
    """
    # Only lines that may be furniture are stored; what is not found among them is body text.
    special = keep(_candidates(shown_lines(chunks)).where("candidata OR numero IS NOT NULL"))
    texts = chunks.where("id IS NOT NULL AND texto IS NOT NULL").select(F.coalesce("doc_id", F.lit("")).alias("doc"), F.xxhash64("texto").alias("texto_id"))
    told = described(special, recurrence(texts, special, settings, keep))
    furniture = keep(classified(told, train_lines(told, settings), settings).where("classe <> 'corpo'"))
    text = running_text(chunks, furniture)
    said = keep(words(text))
    number = keep(counts(said))
    return Repair(furniture, text, said, keep(corrections(number, train_editor(number, settings), settings)))


def noise(found: Repair) -> DataFrame:
    """(chunk_id, ruido, trecho): the distinct pieces of noise of every chunk."""
    furniture = found.lines.select(F.col("chunk").alias("chunk_id"), F.col("classe").alias("ruido"), F.col("linha").alias("trecho"))
    hit = found.words.select("chunk", "palavra").join(found.corrections, "palavra")
    split = hit.where("juntada").select(F.col("chunk").alias("chunk_id"), F.lit("hifen").alias("ruido"), F.col("certa").alias("trecho"))
    misread = hit.where("lida_errada").select(F.col("chunk").alias("chunk_id"), F.lit("caractere").alias("ruido"), F.col("certa").alias("trecho"))
    return furniture.unionByName(split).unionByName(misread).distinct()


def repaired(chunks: DataFrame, found: Repair, *, id: str = "id", text: str = "texto") -> DataFrame:
    """(chunk, texto_limpo): paragraphs without furniture, words whole and put right; case is kept at the front."""
    layout = lines(chunks, id=id, text=text).select("chunk", "pos", "linha")
    kept = layout.join(found.lines.select("chunk", "pos", "classe"), ["chunk", "pos"], "left").where(F.coalesce("classe", F.lit("")) .isin("", "corpo"))
    joined = kept.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "linha"))), lambda s: s["linha"]), "\n").alias("t"))
    joined = joined.withColumn("t", F.regexp_replace("t", r"(?<=\p{L})[-\x{2010}\x{2011}\x{00ac}\x{00ad}]\n+(?=\p{Ll})", JOIN))
    flowing = joined.withColumn("t", F.regexp_replace(F.regexp_replace("t", r"\n{2,}", "\u0002"), r"\n", " "))
    tokens = flowing.select("chunk", F.posexplode(F.split("t", "(?<= )|(?=\u0002)|(?<=\u0002)")).alias("n", "bruta"))
    core = F.lower(F.regexp_replace(F.trim("bruta"), _OUTER, ""))
    fixed = tokens.withColumn("palavra", core).join(found.corrections.select("palavra", "certa"), "palavra", "left")
    shown = F.regexp_replace(F.trim("bruta"), _OUTER, "")
    right = F.when(shown.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("certa", 1, 1)), F.expr("substring(certa, 2)"))).otherwise(F.col("certa"))
    piece = F.when(F.col("certa").isNull(), F.regexp_replace("bruta", JOIN, "")).otherwise(F.replace("bruta", shown, right))
    whole = fixed.withColumn("p", piece).groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]), "").alias("t"))
    return whole.select("chunk", F.trim(F.regexp_replace(F.replace("t", F.lit("\u0002"), F.lit("\n\n")), r" *\n\n *", "\n\n")).alias("texto_limpo"))
