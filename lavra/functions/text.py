"""Text as columns: folding, tokens, keys, citations and abstention. Every function keeps null as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"

# Portuguese query words that carry no topic, folded.
STOPWORDS = (
    "a", "ao", "aos", "as", "ate", "com", "como", "da", "das", "de", "do", "dos",
    "e", "em", "entre", "era", "essa", "esse", "esses", "esta", "estas", "este",
    "estes", "eu", "foi", "foram", "ha", "isso", "isto", "ja", "la", "mais", "mas",
    "meu", "minha", "muito", "na", "nao", "nas", "nem", "no", "nos", "nossa", "nosso",
    "o", "os", "ou", "para", "pela", "pelo", "pelas", "pelos", "por", "qual", "quando",
    "que", "quem", "se", "sem", "sendo", "ser", "seu", "sua", "so", "sobre", "te",
    "tem", "ter", "um", "uma", "umas", "uns", "voce",
)

# What is dropped from a file stem: the version at its end, a course's name in front, and the mark of a copy.
VERSION = r"(\s*\(\d+\)\s*|_\d+)$"
COURSES = (r"nlp\s*[0-9.]*\s*[-–—]?\s*", r"llm[-_]?master[-_\s]*", r"genai[-_\s]*llms[-_\s]*", r"tdp\s*[-–—]\s*", r"oficina\s*[0-9]+\s*[-–—]\s*", r"aula\s*")
COPY_MARKS = (r"c[oó]pia\s*de", r"copy\s*of", "com_copia")
# What a bare abstention is in speech, and phrases of not knowing, folded.
NO_ANSWER = "Não sei responder com base nos materiais do curso."
UNKNOWN, NO_INFORMATION = "nao sei", r"\bnao (ha|tenho|existem?) informa"
# What is never read aloud: citation marks, addresses, signs of markup.
UNSPOKEN = (r"\[\d+\]", r"(?:https?://|www\.)\S+", r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", r"[\x01-\x1f*_#`>|]")


def unmarked(text: Column) -> Column:
    """Lower case without combining accents; composed ones stay."""
    return F.regexp_replace(F.lower(text), r"\p{M}+", "")


def fold(text: Column) -> Column:
    """Lower case without accents, composed or not."""
    return F.translate(unmarked(text), ACCENTED, PLAIN)


def unaccent(text: Column) -> Column:
    """Without accents; case is kept."""
    return F.translate(F.regexp_replace(text, r"\p{M}+", ""), ACCENTED + ACCENTED.upper(), PLAIN + PLAIN.upper())


def tokens(text: Column) -> Column:
    """Folded runs of ASCII letters and digits of at least two characters, with repetition and in order."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]{2,}"), 0)


def all_tokens(text: Column) -> Column:
    """As :func:`tokens`, single characters too."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), 0)


def query_tokens(text: Column) -> Column:
    """Tokens of a query without stop words; repetition is kept, as each repetition counts in the score."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS))


def squeeze(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def router_key(text: Column) -> Column:
    """Folded, spaces collapsed and trimmed."""
    return F.trim(squeeze(fold(text)))


def scan_key(text: Column) -> Column:
    """Folded, line-end hyphens and soft hyphens closed, spaces collapsed."""
    return squeeze(F.regexp_replace(fold(text), "[-­]\\s*", ""))


def duplicate_key(text: Column) -> Column:
    """Lower case with everything but ASCII letters and digits deleted; accented letters vanish."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def word_set(text: Column) -> Column:
    """Distinct runs of at least three ASCII letters or digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), 0))


def lemma(token: Column) -> Column:
    """A token of more than three characters without its final s."""
    return F.regexp_replace(token, "^(.{3,})s$", "$1")


def lemmas(text: Column) -> Column:
    """Lemma-like tokens of at least two characters."""
    return F.transform(F.regexp_extract_all(scan_key(text), F.lit("[a-z0-9]{2,}"), 0), lemma)


def slug(text: Column, longest: int = 60) -> Column:
    """Folded, other characters as single underscores, at most ``longest`` characters, no underscore at the ends."""
    plain = F.regexp_replace(fold(text), "[^a-z0-9]+", "_")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, "^_+|_+$", ""), 1, longest), "_+$", "")


def file_slug(stem: Column) -> Column:
    """Slug of a file stem without version, course names and copy mark; of the whole stem where nothing is left."""
    bare = F.trim(F.regexp_replace(stem, VERSION, ""))
    for front in (rf"(?:{'|'.join(COURSES)})+", rf"(?:{'|'.join(COPY_MARKS)})\s+"):
        bare = F.ltrim(F.regexp_replace(bare, rf"(?i)^{front}", ""))
    return F.coalesce(F.nullif(slug(bare), F.lit("")), slug(stem))


def drop_middle(text: Column) -> Column:
    """The unaccented text without its middle character."""
    t = unaccent(text)
    half = F.floor(F.length(t) / 2).cast("int")
    return F.concat(F.substring(t, F.lit(1), half), F.substring(t, half + 2, F.length(t)))


def swap_middle(text: Column) -> Column:
    """The unaccented text with its middle character and the next one swapped; without the middle one where there is no next."""
    t = unaccent(text)
    half = F.floor(F.length(t) / 2).cast("int")
    swapped = F.concat(F.substring(t, F.lit(1), half), F.substring(t, half + 2, F.lit(1)), F.substring(t, half + 1, F.lit(1)), F.substring(t, half + 3, F.length(t)))
    return F.when(half + 1 >= F.length(t), drop_middle(text)).otherwise(swapped)


def colloquial(text: Column) -> Column:
    """Unaccented, "para que serve" as it is spoken."""
    return F.replace(unaccent(text), F.lit("para que serve"), F.lit("pra que serve"))


def abstains(answer: Column) -> Column:
    """Whether an answer says anywhere that it does not know; null and empty answers do not."""
    key = plain_words(answer)
    return F.coalesce(key.contains(UNKNOWN) | key.rlike(NO_INFORMATION), F.lit(False))


def plain_words(answer: Column) -> Column:
    """Folded words between single spaces, joined words taken apart."""
    return squeeze(F.translate(fold(answer), "_-", "  "))


def abstains_at_front(answer: Column) -> Column:
    """The older test: the mark in front, or the phrase within the first 60 characters."""
    key = fold(F.trim(answer))
    return F.coalesce(key.rlike("^(nao_sei|nao sei)") | F.substring(key, 1, 60).contains("nao ha informacoes"), F.lit(False))


def abstains_by_mark(answer: Column) -> Column:
    """The mark itself, in upper case and without accent."""
    return F.coalesce(F.upper(answer).contains("NAO_SEI"), F.lit(False))


def citations(answer: Column) -> Column:
    """The numbers of all citation marks, in order, with repetition."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))


def is_reference_line(line: Column, extension: str = "pdf") -> Column:
    """Whether a line is one of a list of references: a mark, white space and the name of a file."""
    words = F.split(F.trim(line), r"\s+")
    mark, file = words[0], F.coalesce(F.get(words, F.lit(1)), F.lit(""))
    # What follows the name may touch it, a letter or digit may not.
    name = F.regexp_extract(file, rf"^(.*?)\.{extension}(?![A-Za-z0-9_])", 1)
    return mark.rlike(r"^\[\d+\]$") & file.rlike(rf"\.{extension}(?![A-Za-z0-9_])") & ~name.rlike(r"[^\w.-]")


def without_footer(answer: Column, extension: str = "pdf") -> Column:
    """The answer without the lines that a model wrote as references."""
    return F.array_join(F.filter(F.split(answer, "\n"), lambda line: ~is_reference_line(line, extension)), "\n")


def renumbered(answer: Column, size: Column) -> Column:
    """Struct of the marked text and the kept marks: marks beyond ``size`` go, the others are numbered by first appearance."""
    body = without_footer(answer)
    marks = F.array_distinct(F.filter(citations(body), lambda n: (n >= 1) & (n <= size)))
    # Marks become placeholders first, so that a new number is never taken for an old one.
    held = F.regexp_replace(body, r"\[(\d{1,9})\]", "\u0001$1\u0002")
    placed = F.aggregate(F.transform(marks, lambda n, i: F.struct(n.alias("old"), (i + 1).alias("new"))), held, lambda text, m: F.replace(text, F.concat(F.lit("\u0001"), m["old"].cast("string"), F.lit("\u0002")), F.concat(F.lit("["), m["new"].cast("string"), F.lit("]"))))
    cleaned = F.regexp_replace(placed, "\u0001\\d+\u0002", "")
    return F.struct(F.trim(F.regexp_replace(cleaned, "[ \\t]{2,}", " ")).alias("texto"), marks.alias("marcas"))


def spoken(answer: Column) -> Column:
    """The answer as it is read aloud: no references, marks, addresses or markup; a bare abstention as a sentence."""
    bare = plain_words(F.trim(answer)).isin(UNKNOWN, f"{UNKNOWN}.", f"{UNKNOWN}!")
    # One pass takes out what is not read; the longest kind that begins at a place goes.
    read = F.regexp_replace(F.replace(without_footer(answer), F.lit("\n"), F.lit(" ")), "|".join(UNSPOKEN), " ")
    return F.when(bare, F.lit(NO_ANSWER)).otherwise(F.regexp_replace(F.trim(squeeze(read)), r"\s([.,;:!?])", "$1"))


def options(question: Column) -> Column:
    """The options after the last colon, split at "ou" and commas, of at least three characters."""
    tail = F.regexp_replace(F.trim(F.substring_index(question, ":", -1)), r"\?+$", "")
    parts = F.filter(F.transform(F.split(tail, r"\s+ou\s+|\s*,\s*"), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    return F.when(question.contains(":"), parts).otherwise(F.array().cast("array<string>"))


def fingerprint(prompt: Column) -> Column:
    """First eight hex digits of the SHA-256."""
    return F.substring(F.sha2(prompt, 256), 1, 8)


def without_ansi(text: Column) -> Column:
    """Without terminal colour codes."""
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[A-Za-z]", "")


def first_object(text: Column) -> Column:
    """From the first opening to the last closing brace, as the greedy reader takes it; '' without one."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


VERDICT = "nota INT, correta BOOLEAN, alucinou BOOLEAN, justificativa STRING"


def greedy_verdict(text: Column, schema: str = VERDICT) -> Column:
    """The greedy reader's object as a struct; null where it is no object."""
    return F.from_json(F.nullif(first_object(text), F.lit("")), schema)


def verdict(text: Column, schema: str = VERDICT) -> Column:
    """The first object of a text that holds nota, correta and alucinou, whatever it nests and whatever follows; null where none does."""
    parts = F.split(text, r"\{")
    # Every opening brace with all that follows; the parser stops where its object ends.
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("{"), F.array_join(F.slice(parts, i, F.size(parts)), "{")))
    parsed = F.transform(tails, lambda t: F.from_json(t, schema))
    whole = F.filter(parsed, lambda v: v["nota"].isNotNull() & v["correta"].isNotNull() & v["alucinou"].isNotNull())
    return F.when(F.size(parts) > 1, F.try_element_at(whole, F.lit(1)))


def first_array(text: Column, schema: str) -> Column:
    """The first list of objects in a text: code fences are dropped and commas before a closing bracket mended; null where there is none."""
    plain = F.regexp_replace(text, "```[a-z]*", "")
    listed = F.regexp_extract(plain, r"(?s)\[.*\]", 0)
    return F.from_json(F.nullif(F.regexp_replace(listed, r",\s*([\]}])", "$1"), F.lit("")), f"array<struct<{schema}>>")
