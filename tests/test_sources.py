import json
import zipfile

from lavra.sources import formats as S


def test_pages(spark, tmp_path):
    (tmp_path / "a.MD").write_text("NOTAS DA AULA\ntexto")
    cells = [{"cell_type": "markdown", "source": ["um\n", "dois"]}, {"cell_type": "raw", "source": "x"}, {"cell_type": "code", "source": "print(1) <img src='x'>"}, {"cell_type": "markdown", "source": [" "]}]
    (tmp_path / "b.ipynb").write_text(json.dumps({"cells": cells}))
    (tmp_path / "c.ipynb").write_text("não é json")
    (tmp_path / "e.pptx").write_bytes(b"nada")
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for n, t in ((1, "Slide um"), (2, ""), (10, "Slide dez")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="u"><a:t>{t}</a:t><a:t>x</a:t></p>')
    rows = {(r.doc_id, r.pagina): r.texto for r in S.pages(spark, str(tmp_path)).collect()}
    assert rows[("a.MD", 1)].startswith("NOTAS")
    assert rows[("b.ipynb", 1)] == "# celula 1\num\ndois\n\n# celula 3\nprint(1)"
    assert rows[("d.pptx", 1)] == "Slide um" and rows[("d.pptx", 3)] == "Slide dez"
    assert len(rows) == 4


def test_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\nlixo\n{"id": 2}\n')
    assert sorted(r.id for r in S.json_lines(spark, str(tmp_path / "x.jsonl"), "id int").collect()) == [1, 2]
    (tmp_path / "g.json").write_text(json.dumps({"meta": {}, "perguntas": [{"id": 1, "pergunta": "p", "docs_esperados": ["a"], "deve_abster": False}]}))
    assert S.golden_questions(spark, str(tmp_path / "g.json")).first().pergunta == "p"


def test_resume(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, r string")
    path = str(tmp_path / "out")
    assert S.append_missing(rows.where("id = 1"), path, "id") == 1
    assert S.append_missing(rows, path, "id") == 1
    assert S.append_missing(rows, path, "id") == 0
    verdicts = spark.createDataFrame([(1, "v")], "id int, r string")
    assert sorted((r.id, r.r) for r in S.filled(spark.createDataFrame([(1, None), (2, "b")], "id int, r string"), verdicts, "id", "r").collect()) == [(1, "v"), (2, "b")]
