import random

from lavra.llm.leaks import Automaton, Limits, cleaned, leaked_pairs, passages, scan

ITEMS = "item_id long, texto string, text string"
DOCS = "doc_id long, text string, texto string"


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("lmnrs") + rng.choice("aeiou") + rng.choice("bdgt") + rng.choice("aeo") for _ in range(n)]


def test_passages(spark):
    a, b, filler = words(1, 60), words(2, 10), words(3, 400)
    items = spark.createDataFrame([(1, " ".join(a), "x"), (2, " ".join(b).upper() + ".", "x"), (3, None, "x"), (4, "", "x"), (5, " ".join(a), "x")], ITEMS)
    typo = a[10:45]
    typo[7] = typo[7][:2] + "x" + typo[7][3:]
    del typo[20]
    docs = [
        (1, " ".join(filler[:50] + a[5:25] + filler[50:90])), (2, " ".join(filler[:40] + a[5:24] + filler[40:60])), (3, " ".join(filler[:9]) + "\n" + "\n> ".join(b) + " " + " ".join(filler[9:20])),
        (4, " ".join(filler[20:60] + typo)), (5, None), (6, ""), (7, " ".join(filler * 100)), (8, " ".join(w if k % 4 else "troca" for k, w in enumerate(a))), (9, " ".join(a).title()), (9, " ".join(a).title()),
    ]
    df = spark.createDataFrame([(i, t, "y") for i, t in docs], DOCS)
    found = passages(df, items)
    got = {(r.doc, r.item) for r in found.collect()}
    assert got == {(1, 1), (1, 5), (3, 2), (4, 1), (4, 5), (9, 1), (9, 5)}
    assert {(r.doc, r.item) for r in passages(df, items, limits=Limits(block_words=40)).collect()} == got
    assert {r.item: r.palavras for r in leaked_pairs(found.where("doc = 1")).collect()} == {1: 20, 5: 20}
    cut = {r.doc: r.texto_limpo for r in cleaned(df.where("doc_id <> 9"), found).collect()}
    assert cut[1].split() == filler[:90] and cut[3].split()[:9] == filler[:9]


def test_automaton_against_brute_force():
    rng = random.Random(4)
    sequences = [(k, [rng.choice("abc") for _ in range(12)]) for k in range(6)]
    text = [rng.choice("abcd") for _ in range(80)]
    machine = Automaton(sequences, Limits())
    inside = {tuple(s[i:j]) for _, s in sequences for i in range(12) for j in range(i + 1, 13)}
    for at, _, size in machine.walk(text):
        best = max((n for n in range(1, at + 2) if tuple(text[at + 1 - n : at + 1]) in inside), default=0)
        assert size == best


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b c", "y")], DOCS)
    assert passages(docs, none).count() == 0
    assert passages(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e", "x")], ITEMS)).count() == 0


def held(item, copy):
    filler = words(7, 60)
    machine = Automaton([(1, item)], Limits())
    return [(a, b) for _, a, b, _, _, _ in scan(filler[:30] + copy + filler[30:], {1: item}, machine, Limits())]


def test_errors_anywhere_in_a_short_item():
    item = words(5, 10)
    for k in range(10):
        misspelt = item[k][:2] + "x" + item[k][3:]
        assert held(item, item[:k] + [misspelt] + item[k + 1 :]) == [(0, 10)], k
        assert held(item, item[:k] + item[k + 1 :]) == [(k == 0, 10 - (k == 9))], k
        assert held(item, item[:k] + ["acrescimo"] + item[k:]) == [(0, 10)], k
        if 0 < k < 9:
            assert held(item, item[:k] + ["acrescimo"] + item[k + 1 :]) == [], k
    assert held(item, item[:2] + item[3:7] + item[8:]) == []


def test_errors_near_the_ends_of_an_excerpt():
    item = words(6, 60)
    for size in (20, 22, 25):
        for k in range(1, size - 1):
            copy = item[10 : 10 + size]
            assert held(item, copy[:k] + [copy[k][:2] + "x" + copy[k][3:]] + copy[k + 1 :]) == [(10, 10 + size)], (size, k)
            assert held(item, copy[:k] + copy[k + 1 :]) == [(10, 10 + size)], (size, k)
    assert held(item, item[10:29]) == [] and held(item, item[10:12] + item[13:29]) == []


def test_items_of_one_and_two_words():
    items = {1: ["unico"], 2: ["dois", "termos"], 3: words(5, 10)}
    machine = Automaton(list(items.items()), Limits())
    text = words(7, 8)
    assert scan(text, items, machine, Limits()) == []
    assert {(k, a, b) for k, _, _, a, b, _ in scan(text[:3] + ["unico"] + text[3:5] + ["dois", "termos"] + text[5:] + ["dois"], items, machine, Limits())} == {(1, 3, 4), (2, 6, 8)}


def test_decomposed_text_is_cut_where_the_passage_stands(spark):
    import unicodedata

    from lavra.llm.words import word_spans, words as folded

    a = words(1, 24)
    passage = " ".join(a)
    text = unicodedata.normalize("NFD", "Avaliação é fácil ﬁm: ") + passage + unicodedata.normalize("NFD", ", não é útil. Até já, à noite, há uma reunião; vêm três irmãs, cinco cães, um avô, dois bebês, várias mães, um pão, um órgão e três colchões.")
    assert folded(text) == ["".join(folded(text[i:j])) for i, j in word_spans(text)]
    df = spark.createDataFrame([(1, text, "y")], DOCS)
    found = passages(df, spark.createDataFrame([(1, passage, "x")], ITEMS))
    assert [r.texto_limpo for r in cleaned(df, found, drop_share=0.9).collect()] == [text.replace(passage, "")]


def test_documents_are_read_once_for_several_blocks(spark):
    items = spark.createDataFrame([(k, " ".join(words(k, 30)), "x") for k in range(3)], ITEMS)
    docs = spark.createDataFrame([(k, " ".join(words(k, 30)), "y") for k in range(3)], DOCS)
    found = passages(docs, items, limits=Limits(block_words=20))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert sorted((r.doc, r.item) for r in found.collect()) == [(0, 0), (1, 1), (2, 2)]
