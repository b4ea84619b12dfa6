"""Files, curated tables, stores, and what readers are told, on small cases of our own."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from clausewise.operators import analyzer, assess, explain, extraction, findings, learned, measures, retrieval, rules, segment
from clausewise.plans import factory, shapes
from clausewise.sources import corpus, files, report, vectors, word

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, number=None, depth=0, style=None):
    inner = f'<w:pStyle w:val="{style}"/>' if style else ""
    inner += f'<w:numPr><w:ilvl w:val="{depth}"/><w:numId w:val="{number}"/></w:numPr>' if number else ""
    return f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(body, numbering="", styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/numbering.xml", f"<w:numbering {NS}>{numbering}</w:numbering>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")
    return out.getvalue()


LISTS = (
    '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="%1."/></w:lvl>'
    '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2."/><w:isLgl/></w:lvl></w:abstractNum>'
    '<w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="o"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="1"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="2"/></w:num>'
    '<w:num w:numId="3"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num>'
)


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c if c.startswith('<') else p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def read_word(spark, *contents, prefer="ru"):
    """(text, warnings) of each file, in order."""
    rows = [(i, *word.parts(c)) for i, c in enumerate(contents)]
    got = word.texts(spark.createDataFrame(rows, "path int, document string, numbering string, styles string"), prefer)
    return [(r["text"], r["warnings"]) for r in got.orderBy("path").collect()]


def test_word_numbers(spark):
    styles = f'<w:style w:styleId="A"><w:basedOn w:val="B"/></w:style><w:style w:styleId="B">{"<w:pPr><w:numPr><w:ilvl w:val=%s/><w:numId w:val=%s/></w:numPr></w:pPr>" % (chr(34) + "1" + chr(34), chr(34) + "1" + chr(34))}</w:style><w:style w:styleId="C"><w:basedOn w:val="C"/></w:style>'
    one = docx(p("Предмет", "1") + p("Раз", "1", 1) + p("Два", style="A") + p("Цена", "1") + p("Три", "1", 1) + p("пункт", "2") + p("Снова", "3") + p("") + p("Просто"), LISTS, styles)
    odd = docx(p("круг", style="C") + p("нет", style="Z") + p("нет списка", "9") + p("нет уровня", "1", 7) + p("ноль", "0") + p("", "1") + p("Раз", "1"), LISTS, styles)
    (text, _), (other, _) = read_word(spark, one, odd)
    assert text.split("\n") == ["I. Предмет", "1.1. Раз", "1.2. Два", "II. Цена", "2.1. Три", "• пункт", "V. Снова", "", "Просто"]
    assert other.split("\n") == ["круг", "нет", "нет списка", "нет уровня", "ноль", "", "I. Раз"]
    forms = [(27, "lowerLetter"), (28, "upperLetter"), (11, "russianLower"), (30, "russianUpper"), (1994, "lowerRoman"), (7, "decimalZero"), (7, "odd"), (104, "decimalZero")]
    got = spark.createDataFrame([(i, *f) for i, f in enumerate(forms)], "i int, n int, f string").orderBy("i").select(word.numbered(F.col("n"), F.col("f")))
    assert [r[0] for r in got.collect()] == ["aa", "BB", "л", "ББ", "mcmxciv", "07", "7", "104"]


def test_word_tables(spark):
    both = docx(table(("Жалға алушы төлейді өсімпұл", "Арендатор уплачивает пеню"), ("Жеткізуші өнімді береді", "Поставщик передает товар")))
    goes_on = f'<w:tcPr><w:vMerge/></w:tcPr>{p("выше", "1")}'
    begins = f'<w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{p("Слева")}'
    nested = p("Внешняя") + table(("внутренняя",))
    plain, *_ = read_word(spark, docx(table(("Товар", "Цена", "Срок"), ("Итого",))))
    assert plain == ("Товар | Цена | Срок\nИтого", [])
    ru, cells, inner = read_word(spark, both, docx(p("Раз", "1") + table((begins, "A", "1"), (goes_on, p("B") + p("C", "1"), "2"), ("", "", "")) + p("Два", "1"), LISTS), docx(table((nested, "рядом", "ещё"))))
    assert ru[0] == "Арендатор уплачивает пеню\nПоставщик передает товар" and len(ru[1]) == 1
    assert cells[0].split("\n") == ["I. Раз", "Слева | A | 1", "B II. C | 2", "III. Два"]
    assert inner[0] == "Внешняя | рядом | ещё"
    [(text, warnings)] = read_word(spark, both, prefer="kk")
    assert text.startswith("Жалға алушы") and len(warnings) == 1


def test_word_runs_and_edges(spark):
    run = "<w:r><w:t>{}</w:t></w:r>".format
    box = f'<w:r><w:txbxContent>{p("в рамке")}</w:txbxContent></w:r>'
    body = f'<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs><w:pPrChange><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:pPrChange></w:pPr>{run("a &amp;lt; &#1040;&#x41;")}<w:r><w:tab/><w:br/></w:r>{box}<!-- <w:t>x</w:t> --><w:ins>{run("<![CDATA[<b>]]>")}</w:ins><w:del><w:r><w:delText>нет</w:delText></w:r></w:del></w:p><w:p/><w:sdt><w:sdtContent>{p("в поле")}</w:sdtContent></w:sdt>{p("конец")}'
    other = docx(p("свой"))
    with zipfile.ZipFile(io.BytesIO(other)) as z:
        document = z.read("word/document.xml").decode()
    rows = [(0, *word.parts(docx(body, LISTS)), "x"), (1, document.replace("w:", "ns0:").replace("xmlns:w=", "xmlns:ns0="), None, None, "y"), (2, None, None, None, None), (3, *word.parts(docx("")), "z"), (4, "<w:p>", None, None, "bad"), (None, document, None, None, "null key"), (0, document, "<no", None, "bad list"), (5, document, None, None, "twice"), (5, document, None, None, "twice")]
    files_ = spark.createDataFrame(rows, "path int, document string, numbering string, styles string, text_of string").withColumnRenamed("text_of", "pos").withColumn("token", F.lit(1))
    all_ = word.texts(files_).collect()
    got = {r["pos"]: r for r in all_}
    assert len(all_) == len(rows) and [r["text"] for r in all_ if r["pos"] == "twice"] == ["свой", "свой"]
    assert got["x"]["text"] == "a &lt; АA\t\n<b>\n\nконец"
    assert [got[k]["text"] for k in ("y", None, "z", "bad", "null key", "bad list")] == ["свой", None, "", None, "свой", None]
    assert got["bad"]["warnings"] == got["bad list"]["warnings"] == [word.UNREADABLE] and got["x"]["warnings"] == [] and got["z"]["token"] == 1
    assert word.texts(files_.limit(0)).count() == 0


def shown_by_scanning(paragraphs, starts, again):
    """Numbers of (list, depth) paragraphs by looking back for each: the definition, in quadratic time."""
    abstract = {"1": "A", "2": "A", "3": "B"}
    begins = {i for i, (n, _) in enumerate(paragraphs) if again.get(n) and n not in [m for m, _ in paragraphs[:i]]}

    def number(i, d):
        n = paragraphs[i][0]
        mine = []
        for j in range(i, -1, -1):
            if abstract[paragraphs[j][0]] != abstract[n]:
                continue
            if paragraphs[j][1] == d:
                mine.append(j)
            if paragraphs[j][1] < d or j in begins:
                break
        at = paragraphs[mine[-1]][0] if mine else n
        return again.get(at, {}).get(d, starts[abstract[n]][d]) + max(0, len(mine) - 1)

    return [".".join(str(number(i, d)) for d in range(depth + 1)) for i, (_, depth) in enumerate(paragraphs)]


def test_word_counts_by_brute_force(spark):
    rnd = random.Random(5)
    starts = {"A": [1, 1, 3], "B": [2, 0, 1]}
    again = {"2": {0: 4, 2: 7}}
    levels = {a: "".join(f'<w:lvl w:ilvl="{d}"><w:start w:val="{s}"/><w:lvlText w:val="{".".join(f"%{k + 1}" for k in range(d + 1))}"/></w:lvl>' for d, s in enumerate(v)) for a, v in starts.items()}
    lists = "".join(f'<w:abstractNum w:abstractNumId="{a}">{v}</w:abstractNum>' for a, v in levels.items())
    lists += "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{a}"/>{"".join(f"""<w:lvlOverride w:ilvl="{d}"><w:startOverride w:val="{s}"/></w:lvlOverride>""" for d, s in again.get(n, {}).items())}</w:num>' for n, a in (("1", "A"), ("2", "A"), ("3", "B")))
    cases = [[(rnd.choice("112233"), rnd.randrange(3)) for _ in range(rnd.randrange(1, 25))] for _ in range(60)]
    got = read_word(spark, *[docx("".join(p(f"т{i}", n, d) for i, (n, d) in enumerate(c)), lists) for c in cases])
    for case, (text, _) in zip(cases, got, strict=True):
        assert text.split("\n") == [f"{n} т{i}" for i, n in enumerate(shown_by_scanning(case, starts, again))]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Договор аренды".encode("cp1251"))
    (tmp_path / "b.docx").write_bytes(docx(p("Текст")))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.xyz").write_bytes(b"?")
    got = {r["path"][-5:]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["text"] == "Договор аренды\n" and got["a.txt"]["warnings"]
    assert [r["text"] for r in files.read(spark, str(tmp_path)).where("path like '%b.docx'").collect()] == ["Текст\n"]
    assert got["d.xyz"]["text"] is None and got["d.xyz"]["source_format"] is None


def test_pages(spark):
    long = "строка текста, которой хватает на страницу договора"
    pages = spark.createDataFrame([(1, i, f"ТОО Колонтитул\n{long} {i}") for i in range(4)] + [(2, 0, " x "), (2, 1, None), (3, 0, long + "(cid:1)" * 30)], "doc_id int, page_no int, text string")
    scans = {r["doc_id"]: (r["needs_ocr"], len(r["warnings"])) for r in files.scans(pages).collect()}
    assert scans == {1: (False, 0), 2: (True, 1), 3: (True, 2)}
    one = files.assembled(pages).where("doc_id = 1").first()
    assert one["text"] == "".join(f"{long} {i}\n" for i in range(4)) and one["page_starts"] == [i * (len(long) + 3) for i in range(4)]


def test_corpus(spark, tmp_path):
    (tmp_path / "clauses").mkdir()
    (tmp_path / "sources.yaml").write_text("sources:\n- {id: s1, title: T, license_status: authored_cc0}\n- {id: s2, title: T, license_status: candidate}\n")
    (tmp_path / "clauses" / "lease.yaml").write_text("contract_type: lease\nsource: s1\nclauses:\n- {id: a, category: penalty, lang: ru, favours: neutral, text: 'Пеня  0,1%.'}\n- {id: b, category: penalty, lang: ru, favours: tenant, text: Нет.}\n")
    got = {r["id"]: r for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert got["a"]["text"] == "Пеня 0,1%." and got["b"]["source_id"] == "s1" and got["b"]["contract_type"] == "lease"
    same = [corpus.content_hash(d, "id", ["text"]).first()["hash"] for d in (corpus.load_corpus(spark, str(tmp_path)), corpus.load_corpus(spark, str(tmp_path)).orderBy(F.desc("id")))]
    assert same[0] == same[1] and len(same[0]) == 16
    (tmp_path / "clauses" / "works.yaml").write_text("contract_type: works\nsource: s2\nclauses:\n- {id: c, category: penalty, lang: ru, favours: neutral, text: x}\n")
    with pytest.raises(corpus.LicenceError, match="candidate"):
        corpus.load_corpus(spark, str(tmp_path))


def test_split(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("ДОГОВОР\n1.1. Текст.\n")
    (tmp_path / "d1.yaml").write_text("doc_id: d1\ncontract_type: lease\nlanguage: ru\nparty_role: tenant\norigin: own\nfindings:\n- {clause: '1.1', category: penalty, level: high}\n- {category: liability, level: low}\n")
    docs, gold = corpus.load_split(spark, str(tmp_path))
    assert docs.first()["text"].startswith("ДОГОВОР") and sorted(r["category"] for r in gold.collect()) == ["liability", "penalty"]
    assert corpus.missing_clauses(gold, segment.clauses(docs)).count() == 0
    assert corpus.dump_labels(docs, gold).first()["yaml"].count("category") == 2


def test_labels_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "lease", "ru", "tenant", "real: yes"), ("d2", "supply", "kk", "buyer", None)], "doc_id string, contract_type string, language string, party_role string, origin string")
    gold = spark.createDataFrame([("d1", "1.10", "penalty", "high", None, 'a "b": {c}\n# d'), ("d1", "1.1", "penalty", "low", "t1", None), ("d1", None, "liability", "low", None, "true")], "doc_id string, clause string, category string, level string, trap_id string, note string")
    for r in corpus.dump_labels(docs, gold).collect():
        (tmp_path / f"{r['doc_id']}.yaml").write_text(r["yaml"], encoding="utf-8")
        (tmp_path / f"{r['doc_id']}.txt").write_text("ДОГОВОР", encoding="utf-8")
    back, labels = corpus.load_split(spark, str(tmp_path))
    columns = gold.columns
    assert sorted(map(str, labels.select(*columns).collect())) == sorted(map(str, gold.collect()))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_store(spark, tmp_path):
    store = vectors.Store(spark, str(tmp_path / "v"), "hashing", "1")
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0])], "id string, vector array<double>")
    assert store.load(rows) and not store.load(rows)
    store.add(spark.createDataFrame([("b", [0.0, 2.0]), ("c", [1.0, 0.0])], rows.schema))
    assert {r["id"]: r["vector"] for r in store.rows().collect()} == {"a": [0.6, 0.8], "b": [0.0, 1.0], "c": [1.0, 0.0]}
    with pytest.raises(vectors.MismatchError):
        vectors.Store(spark, str(tmp_path / "v"), "hashing", "2").load(rows)
    with pytest.raises(ValueError):
        vectors.embedder("none")


def test_redaction(spark):
    cases = {"Иванов И.И. подписал": "[ФИО] подписал", "в лице А. Б. Петровой, далее": "в лице [ФИО], далее", "Сидоров Пётр Ильич": "[ФИО]", "счёт KZ12 3456 7890 ABCD 1234, БИН 123456789012": "счёт [IBAN], БИН [ИИН/БИН]", "a.b@mail.kz, +7 (701) 123-45-67": "[EMAIL], [ТЕЛЕФОН]", "ст. 297 ГК, пеня 0,1% за 10 дней": "ст. 297 ГК, пеня 0,1% за 10 дней"}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    text, n = extraction.redacted(F.col("text"))
    got = {r["text"]: (r["r"], r["n"]) for r in df.select("text", text.alias("r"), n.alias("n")).collect()}
    assert {t: r for t, (r, _) in got.items()} == cases
    assert [n for _, n in got.values()] == [1, 1, 1, 2, 2, 0]


def test_places_of_quotes(spark):
    text = "Арендатор  уплачивает\n«пеню» 1% (один процент) за каждый день, ещё раз."
    rows = [("арендатор уплачивает \"ПЕНЮ\" 1%", "Арендатор  уплачивает\n«пеню» 1%"), ("(один процент)", "(один процент)"), ("еще раз.", "ещё раз"), ("пени 2%", None), ("1%", None), ("..", None), (None, None)]
    got = spark.createDataFrame([(i, q, text) for i, (q, _) in enumerate(rows)], "i int, q string, t string").select("i", extraction.place_of(F.col("q"), F.col("t")).alias("p")).orderBy("i").collect()
    for r, (_, want) in zip(got, rows, strict=True):
        assert (r["p"] and r["p"]["quote"]) == want
        assert want is None or text[r["p"]["start"] : r["p"]["end"]] == want


def keeper(spark, folder):
    n = iter(range(1000))

    def keep(df, schema=None):
        at = f"{folder}/{next(n)}"
        df.write.parquet(at)
        return spark.read.parquet(at) if schema is None else spark.read.schema(schema).parquet(at)

    return keep


def test_assessment(spark, tmp_path):
    def reply(prompt):
        assert "123456789012" not in prompt
        if "молчит" in prompt:
            raise ConnectionError("down")
        a = {"is_risky": True, "category": "penalty", "level": "high", "evidence_quote": "Пеня  1%", "explanation": "Дорого.", "confidence": 3 if "два" in prompt else 0.9}
        return json.dumps(a | ({"evidence_quote": "чужая цитата"} if "ложь" in prompt else {}) | ({"level": "huge"} if "плохо" in prompt else {}))

    keep = keeper(spark, tmp_path)
    texts = ["Пеня 1% раз, БИН 123456789012", "Пеня 1% два", "Пеня 1% ложь", "Пеня 1% плохо", "Пеня 1% молчит"]
    clauses = spark.createDataFrame([(i, "tenant", "1.1", 0, "Раздел", t) for i, t in enumerate(texts)], "doc_id int, party_role string, clause_id string, clause_ord int, section_title string, text string")
    empty = spark.createDataFrame([], assess.CACHE)
    answers, gained = assess.assessed(clauses, extraction.Mock(reply), "m", empty, keep)
    judged = assess.judged(answers)
    assert {r["doc_id"]: r["disposition"] for r in judged.collect()} == {0: "accepted", 1: "accepted", 2: "rejected_ungrounded", 3: "rejected_invalid", 4: "error"}
    found = {r["doc_id"]: r for r in assess.findings_of(judged, "m").collect()}
    assert found[0]["level"] == 3 and found[1]["confidence"] == 1.0 and found[0]["evidence"][0]["quote"] == "Пеня 1%"
    gained = keep(gained)
    assert gained.count() == 4

    def never(prompt):
        if "молчит" in prompt:
            raise ConnectionError("down")
        raise AssertionError("asked again")

    again, _ = assess.assessed(clauses, extraction.Mock(never), "m", gained, keep)
    assert again.where("cached").count() == 4


def test_learning(spark, tmp_path):
    keep = keeper(spark, tmp_path)
    rows = []
    for i in range(48):
        risky = i % 2 == 0
        text = f"За просрочку Арендатор уплачивает Арендодателю пеню {i % 3 + 1}% за каждый день." if risky else f"Арендодатель передает Арендатору помещение {i} площадью {i} метров."
        rows.append((i // 4, str(i), text, "ru", "tenant", int(risky), ("penalty" if i % 4 else "payment") if risky else None, 3 if risky else None))
    frame = spark.createDataFrame(rows, "doc_id int, clause_id string, text string, lang string, party_role string, risky int, category string, level int")
    model = learned.train(frame, keep, k=2)
    model.save(spark, str(tmp_path / "model"))
    loaded = learned.ClauseModel.load(spark, str(tmp_path / "model"))
    assert loaded == model and model.measured["by_doc_f1"] > 0.9
    new = spark.createDataFrame([(1, "Арендатор уплачивает Арендодателю пеню 2% за каждый день.", "ru", "tenant"), (2, "Арендодатель передает Арендатору помещение 7.", "ru", "tenant"), (3, None, "ru", "tenant")], "i int, text string, lang string, party_role string")
    got = {r["i"]: r for r in loaded.scored(learned.relative(new)).collect()}
    assert got[1]["score"] > 0.5 > got[2]["score"] and got[1]["reasons"] and got[1]["relative"].startswith("USER_nom уплачивает CP_dat пеню 2% за каждый день. RATE_HIGH NOCAP")
    assert learned.humanized("cp_nom вправе") == "контрагент вправе" and learned.humanized("rate_high nocap") == "пеня от 0,5% в день без потолка неустойки"
    assert learned.folds([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        learned.train(frame.where("risky = 1"), keep, k=2)


def test_every_row_is_learned_from(spark, tmp_path):
    """A risky wording that occurs once among thousands of rows is known; equal rows are one, and count."""
    said = ["Помещение осмотрено.", "Срок указан в акте.", "За просрочку Арендатор уплачивает пеню 1% за каждый день.", "Арендатор уплачивает пеню 2% за каждый день."]
    rows = spark.range(6_000).selectExpr("cast(id div 4 as int) AS doc_id", "cast(id as string) AS clause_id", f"element_at(array({', '.join(map(repr, said))}), cast(id % 4 as int) + 1) AS text", "int(id % 4 > 1) AS risky", "if(id % 4 > 1, 'penalty', null) AS category", "if(id % 4 > 1, 3, null) AS level")
    rare = spark.range(3).selectExpr("cast(id + 9000 as int) AS doc_id", "'r' AS clause_id", "'Задаток не возвращается.' AS text", "1 AS risky", "'termination' AS category", "2 AS level")
    frame = rows.unionByName(rare).withColumn("lang", F.lit("ru")).withColumn("party_role", F.lit("tenant"))
    kept, keep = [], keeper(spark, tmp_path)
    model = learned.train(frame, lambda df, schema=None: kept.append(keep(df, schema)) or kept[-1], k=2)
    assert model.categories == ["penalty", "termination"] and model.levels == [2, 3] and "задаток" in model.terms.known["words"]
    assert kept[0].agg({"n": "sum"}).first()[0] == 6_003 and kept[1].agg({"n": "sum"}).first()[0] == 6_003 and kept[1].count() <= 10


def test_a_wording_is_scored_once(spark):
    class Model:
        def scored(self, rows):
            self.seen = rows.count()
            return rows.select("*", F.length("text").cast("double").alias("score"), F.col("party_role").alias("category"), F.lit(1).alias("level"), F.array().cast("array<string>").alias("reasons"))

    said = ["Арендатор уплачивает пеню 1% за каждый день.", "Помещение осмотрено.", "Помещение осмотрено.", " "]
    clauses = spark.createDataFrame([(1 + i % 2, f"2.{i}", i, t, "ru", "clause", "lease") for i, t in enumerate(said)], "doc_id int, clause_id string, clause_ord int, text string, lang string, kind string, category string")
    asked = spark.createDataFrame([(1, "tenant"), (2, "tenant"), (2, None)], "doc_id int, party_role string")
    model = Model()
    got = learned.scored(clauses, asked, model)
    rows = sorted((r["doc_id"], r["clause_id"], r["party_role"] or "", r["score"], r["category"]) for r in got.collect())
    assert rows == [(1, "2.0", "tenant", float(len(said[0])), "tenant"), (1, "2.2", "tenant", 20.0, "tenant"), (2, "2.1", "", 20.0, None), (2, "2.1", "tenant", 20.0, "tenant")]
    assert model.seen == 3 and {"relative", "tokens", "level", "reasons"} <= set(got.columns) and got.columns.count("category") == 1


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ДОГОВОР ПОСТАВКИ\n1. Предмет\n1.1. Поставщик поставляет товар.\n2. Ответственность\n2.1. За просрочку Поставщик уплачивает пеню 1% за каждый день.\n"), (2, "")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "supplier"), (1, "tenant"), (2, "buyer")], "doc_id int, party_role string")
    refs = spark.createDataFrame([("r1", "supply", "penalty", "ru", "neutral", "Сторона уплачивает пеню 0,1% за каждый день, но не более 10%.", "s")], "id string, contract_type string, category string, lang string, favours string, text string, source_id string")
    keep = keeper(spark, tmp_path)
    detect = lambda c, q: findings.dedupe(findings.of_clauses(c, q, (rules.daily_rate,)))
    report = keep(analyzer.reports(docs, asked, keep, detect, refs))
    got = {(r["doc_id"], r["party_role"]): r for r in report.collect()}
    mine = got[1, "supplier"]
    assert mine["high"] == 1 and mine["findings"][0]["title"] == explain.TEXTS["penalty.daily_rate"][0] and mine["verdict"].startswith("Подписывать")
    assert mine["findings"][0]["comparison"][0]["differences"] == ["Дневная пеня: 1 %, в образце 0,1 %.", "Предел неустойки: не установлен, в образце 10 %."]
    assert "Поставка" in got[1, "tenant"]["warnings"][0] and got[2, "buyer"]["clauses_analysed"] == 0 and len(got[2, "buyer"]["warnings"]) == 2
    assert json.loads(analyzer.json(report).where("doc_id = 1 and party_role = 'supplier'").first()["json"])["high"] == 1


def test_reports_send_no_contracts_through_the_driver(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ДОГОВОР ПОСТАВКИ\n1. Предмет\n1.1. Поставщик поставляет товар.\n1.2. За просрочку Поставщик уплачивает пеню 1% за каждый день.\n")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "supplier")], "doc_id int, party_role string")
    keep = keeper(spark, tmp_path)
    detect = lambda c, q: findings.dedupe(findings.of_clauses(c, q, (rules.daily_rate,)))
    reports = analyzer.reports(docs, asked, keep, detect)
    clauses = keep(segment.clauses(docs))
    pages = report.html(keep(findings.ordered(detect(clauses, asked))), clauses)
    for made in (reports, pages):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert reports.first()["clause_texts"] == {"1.2": "За просрочку Поставщик уплачивает пеню 1% за каждый день."}
    said = pages.first()["html"]
    assert "<blockquote>" in said and all(t in said for t in explain.TEXTS["penalty.daily_rate"][:3]) and "ст. 297" in said


def test_every_rule_is_explained():
    assert set(factory.WORDINGS) <= set(explain.TEXTS)


def segmented(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.asDict(recursive=True) for r in segment.segmented(df).orderBy("id").collect()]


def test_looks_by_few_letters_are_those_by_all(spark):
    """What is ruled out by a line's end or its first small letters is what the whole pattern or count rules out."""
    heads = ["А" * n + "а" * (size - n) for size in (90, 100) for n in range(55, 86)] + ["ОПЛАТА", "ОПЛАта Производится", "Оплата", "Б" * 7 + "б" * 3, "x 1"]
    ends = [a + b for a in ("согласно ", "", "и,", "тип", "с") for b in ("п.", "пп.", "ст.", "СТ.", "пункт", "пункте 3", "№", "№.", "разделом", "статья.", "бап", "тармақта", ";", "п", "ппп.")]
    rows = spark.createDataFrame([(t,) for t in heads + ends], "t string")
    t = F.col("t")
    share = segment.capitals(t)
    got = rows.select(
        "t", (segment.refers(t) == t.rlike(segment.REFERENCE)).alias("refers"), (~segment.small(t, 100, segment.CAPITAL_HEADING) | (share < segment.CAPITAL_HEADING)).alias("heading"),
        ((F.length("t") > 90) | ~segment.small(t, 90, segment.CAPITAL_TITLE) | (share < segment.CAPITAL_TITLE)).alias("title"),
    )
    assert [r["t"] for r in got.collect() if not (r["refers"] and r["heading"] and r["title"])] == []
    assert rows.where(segment.refers(t)).count() > 20 and rows.where(segment.small(t, 100, segment.CAPITAL_HEADING)).count() > 5


def test_shapes(spark):
    texts = [t.replace("{k}", "15") for t, _ in shapes.SHAPES]
    for text, (_, want), got in zip(texts, shapes.SHAPES, segmented(spark, texts), strict=True):
        assert [(c["id"], *[c[k] for k in shapes.ROW[1:]]) for c in got["__clauses"]] == [tuple(x.replace("{k}", "15") if isinstance(x, str) else x for x in w) for w in want]
        for c in got["__clauses"]:
            assert text[c["start"] : c["end"]].strip().startswith((c["number"] or c["text"])[:5])


def test_segments_at_the_edges(spark):
    texts = ["ДОГОВОР АРЕНДЫ\n№ 15\nг. Алматы\n1. ПРЕДМЕТ\n1.1. Арендодатель передает\n15 (пятнадцать) помещений, см. п.\n5.3 акта.\n1.2. Срок:\n- год;\n2. РЕКВИЗИТЫ СТОРОН\nАрендатор", None, "Один абзац.\n\nДругой.", " \n\t\n", "ДОГОВОР\n1. Предмет\n1.1. Раз.\nПРИЛОЖЕНИЕ 1\n1. Предмет\n1.1. Два.\nПриложение № 1\n1. Снова\n1.1. Три.", "\tПервый \nабзац  \n \nи второй\n"]
    got = segmented(spark, texts)
    first = got[0]
    assert first["__title"] == "ДОГОВОР АРЕНДЫ № 15" and [c["id"] for c in first["__clauses"]] == ["preamble", "1", "1.1", "1.2", "2"]
    assert first["__clauses"][2]["text"].endswith("5.3 акта.") and first["__clauses"][3]["text"] == "Срок:\n- год;" and first["__clauses"][4]["kind"] == "requisites"
    assert got[1]["__clauses"] == got[3]["__clauses"] == [] and len(got[2]["__clauses"]) == 2 and got[2]["__warnings"] == [segment.UNNUMBERED]
    assert [c["id"] for c in got[4]["__clauses"]] == ["1", "1.1", "прил1", "прил1.1", "прил1.1.1", "прил1~2", "прил1.1~2", "прил1.1.1~2"]
    assert got[4]["__warnings"] == [f"number {i} occurs again: {i}~2" for i in ("прил1", "прил1.1", "прил1.1.1")]
    assert [(c["start"], c["end"], c["text"]) for c in got[5]["__clauses"]] == [(1, 14, "Первый абзац"), (19, 27, "и второй")]
    long = segmented(spark, ["ДОГОВОР\n" + "\n".join(f"{i}. Пункт номер {i} договора сторон, которые согласны во всём." for i in range(1, 400))])[0]
    assert len(long["__clauses"]) == 399 and long["__clauses"][-1]["id"] == "399"


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "пеня за день"), (2, "пеня за  ДЕНЬ"), (3, "аванс и оплата"), (4, "")], "id int, text string")
    v = {r["id"]: r["v"] for r in df.select("id", retrieval.hashed_vector(F.col("text")).alias("v")).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    assert abs(dot(1, 1) - 1) < 1e-9 and abs(dot(1, 2) - 1) < 1e-9 and dot(1, 3) < 0.3 and not any(v[4])


def test_intervals_and_parties(spark):
    acc = spark.createDataFrame([(i, float(i % 4 != 0)) for i in range(40)], "pos long, accuracy double")
    r = measures.macro_interval(acc).first()
    assert 0.5 < r["low"] < 0.75 < r["high"] < 0.95
    party = "array<struct<role:string,name:string,bin:string>>"
    df = spark.createDataFrame([([("buyer", "ТОО «Альфа»", None), ("supplier", "АО Бета", "1")], [("supplier", "Бета", "1"), ("buyer", "альфа", None)])], f"a {party}, b {party}")
    assert df.select(extraction.same_parties(F.col("a"), F.col("b")).alias("s")).first()["s"]


def test_rows_that_stand_for_equal_clauses(spark):
    """What becomes of clauses is the same whether each is a row or equal ones are a row with their number."""
    each = [("accepted", False)] * 3 + [("accepted", True)] * 2 + [("refusal", False)]
    grouped = [("accepted", False, 3), ("accepted", True, 2), ("refusal", False, 1)]
    one = assess.counters(spark.createDataFrame(each, "disposition string, cached boolean"))
    many = assess.counters(spark.createDataFrame(grouped, "disposition string, cached boolean, lines long"), "lines")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) == [("accepted", 5, 2), ("refusal", 1, 0)]
    assert one.dtypes == many.dtypes
