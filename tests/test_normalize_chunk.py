"""HTML, judgments, statutes and chunks."""

from pyspark.sql import functions as F

from lexloom.operators import acts, chunking, normalize
from lexloom.operators.html import html_to_text

ACT = """<div class="unit_chpt"><h3>Rozdział 1</h3>
<div class="unit unit_arti" id="a1" data-id="arti_1"><h3>Art. 1.</h3><p>Treść artykułu pierwszego.</p></div>
<div class="unit unit_arti pro-cite-text" data-id="arti_2"><p>Cytat.</p></div>
<div class="unit unit_arti" id="a2" data-id="arti_2"><h3>Art. 2.</h3>Wstęp dłuższy niż dwadzieścia znaków.
 <div class="unit unit_para" id="p1" data-id="para_1"><h3>§ 1.</h3>Kto:
   <div class="unit unit_pint" data-id="pint_1"><h3>1)</h3>jeden;</div><div class="unit unit_pint" data-id="pint_2"><h3>2)</h3>dwa.</div></div>
 <div class="unit unit_para"><h3>§ 2a.</h3>Drugi paragraf.</div></div></div>"""


def test_html_to_text():
    assert html_to_text(None) == "" and html_to_text(" \n") == ""
    html = "<!-- x --><script>bad()</script><p>A&nbsp;b &amp; c</p><div>x<br>y</div><ul><li>1<li>2</ul>"
    assert html_to_text(html) == "A b & c\n\nx\ny\n1\n2" or html_to_text(html).replace("\n\n", "\n") == "A b & c\nx\ny\n1\n2"
    assert html_to_text("<p>a</p>\r\n\r\n\r\n<p>b</p>") == "a\n\nb"


def test_act_units():
    rows = acts.act_html_segments(ACT, "Kodeks")
    assert [(r["article"], r["paragraph"], r["point"]) for r in rows] == [("1", None, None), ("2", None, None), ("2", "1", "1"), ("2", "1", "2"), ("2", "2a", None)]
    assert rows[0]["header"] == "Kodeks, Rozdział 1, Art. 1" and rows[0]["text"].startswith("Kodeks, Rozdział 1, Art. 1\n")
    assert rows[1]["text"].endswith("Wstęp dłuższy niż dwadzieścia znaków.")
    assert rows[1]["char_start"] == len(rows[0]["text"]) + 2
    assert acts.act_html_segments("<div class='unit_para' data-id='para_1'>Treść.</div>", "R")[0]["label"] == "§ 1"
    assert acts.act_html_segments("", "R") == []


def test_flat_text_units():
    text = ("Preambuła art. 9. Art. 5. cytat Załącznik do obwieszczenia X Art. 1. Kto § 1. pierwszy Dziennik Ustaw – 3 – Poz. 17 dalej § 2. (uchylony) "
            "Art. 2. (uchylony) Art. 3. Jeden artykuł.")
    rows = acts.act_text_segments(text, "K")
    assert [(r["article"], r["paragraph"], r["text"].split("\n")[1]) for r in rows] == [("1", "1", "pierwszy dalej"), ("3", None, "Jeden artykuł.")]
    assert [r["label"] for r in acts.act_text_segments("§ 1. A b. § 2. C d.", "K")] == ["§ 1", "§ 2"]


def test_variants():
    rows, issues = acts.mark_variants(acts.act_text_segments("Art. 1. a. Art. 1. b. Art. 2. c.", "K"))
    assert [r["label"] for r in rows] == ["Art. 1 (wariant 1/2)", "Art. 1 (wariant 2/2)", "Art. 2"]
    assert rows[1]["text"] == "K, Art. 1 (wariant 2/2)\nb." and len(issues) == 1


def sections(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    return [(s["label"], s["char_start"], s["text"]) for s in df.select(normalize.judgment_sections(F.col("t"))).first()[0]]


def test_judgment_sections(spark):
    assert sections(spark, "Sygn. WYROK w imieniu UZASADNIENIE dlaczego") == [("komparycja", 0, "Sygn."), ("sentencja", 6, "WYROK w imieniu"), ("uzasadnienie", 22, "UZASADNIENIE dlaczego")]
    assert sections(spark, "sam tekst") == [("document", 0, "sam tekst")]
    assert sections(spark, "x UZASADNIENIE a WYROK b") == [("komparycja", 0, "x UZASADNIENIE a"), ("sentencja", 17, "WYROK b"), ("uzasadnienie", 2, "UZASADNIENIE a WYROK b")]
    assert sections(spark, "wstęp UZASADNIENIE a") == [("uzasadnienie", 6, "UZASADNIENIE a")]
    assert sections(spark, "UZASADNIENIE\n☐ pole\nnie dotyczy\nZWIĘŹLE o powodach x\ntreść\n\n\n\nkoniec") == [("uzasadnienie", 0, "UZASADNIENIE\ntreść\n\nkoniec")]
    assert sections(spark, "") == []


def test_normalized_documents(spark):
    raw = spark.createDataFrame([
        ("SAOS", "1", "<p>Dnia 5 maja 2015 r. WYROK x</p>", '{"courtType":"COMMON","judgmentType":"SENTENCE","judgmentDate":"3013-01-01","courtCases":[{"caseNumber":"I C 1/20"}],"judges":[{"name":"A"},{"name":" "}]}', "u"),
        ("SAOS", "2", "", None, None)], "source string, external_id string, raw_content string, payload string, source_url string")
    got = {r["external_id"]: r for r in normalize.normalize_judgments(raw, F.lit("2026-01-01").cast("date")).collect()}
    assert got["1"]["title"] == "SENTENCE I C 1/20" and str(got["1"]["judgment_date"]) == "2015-05-05" and len(got["1"]["quality_issues"]) == 2
    assert got["2"]["segments"] == [] and got["2"]["title"] == "Orzeczenie"
    payload = '{"title":"Ustawa z dnia 6 czerwca 1997 r. - Kodeks karny.","inForce":"IN_FORCE","keywords":["k"],"keywordsNames":[],"references":{"Inf. o tekście jednolitym":[{"id":"DU/2020/5"},{"id":"DU/2021/1"}],"Akty zmieniające":[{"id":"DU/2021/3","date":"2021-02-01"},{"id":"DU/2019/9"}]}}'
    raw = spark.createDataFrame([("ELI", "DU/1997/553", ACT, "html", payload, None), ("ELI", "DU/1/1", "pusty", "pdf-text", None, None)],
                                "source string, external_id string, raw_content string, content_format string, payload string, source_url string")
    got = {r["external_id"]: r for r in normalize.normalize_acts(raw).collect()}
    act = got["DU/1997/553"]
    assert len(act["segments"]) == 5 and act["in_force"] and act["segments"][0]["header"].startswith("Kodeks karny")
    assert '"consolidatedTextId":"DU/2021/1"' in act["typed_metadata"] and "DU/2021/3" in act["typed_metadata"] and "DU/2019/9" not in act["typed_metadata"]
    assert got["DU/1/1"]["quality_issues"] == []
    report = normalize.quality_report(normalize.normalize_acts(raw)).first()
    assert (report["docs"], report["empty"]) == (2, 0)


def test_chunks_keep_their_bounds(spark):
    long_line = "słowo " * 900
    text = "\n".join([f"To jest linia numer {i} z kilkoma słowami treści" for i in range(120)] + [long_line.strip(), "☐ ☐", "ab cd"])
    segs = spark.createDataFrame([("d", 0, text, 100), ("d", 1, "x y", 0), ("d", 2, "Krótki tekst który ma jednak pięć słów", 5)], "doc_id string, seg int, text string, char_start int")
    got = chunking.chunk_segments(segs).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert all(r["token_count"] <= 512 and r["char_end"] - r["char_start"] == len(r["text"]) for r in got)
    lines = [set(r["text"].split("\n")) for r in got]
    assert lines[0] & lines[1]
    assert got[-1]["char_start"] == 5


def test_pack_progress_and_halving():
    opts = chunking.ChunkOptions(target_tokens=4, max_tokens=4, overlap_tokens=3, min_words=0)
    packed = chunking.pack_lines([(c, i) for i, c in enumerate("abcdef")], [2, 2, 2, 2, 2, 2], opts)
    assert [p[0] for p in packed] == ["a\nb", "b\nc", "c\nd", "d\ne", "e\nf"]
    units, sizes = chunking.bounded_lines("a b c d e f g", chunking.count_words, 2)
    assert max(sizes) <= 2 and "".join(u[0] for u in units).replace(" ", "") == "abcdefg"
    assert chunking.halves(("abcdef", 3)) == [("abc", 3), ("def", 6)]


def test_in_force_by_json_kind(spark):
    flags = ['"IN_FORCE"', '"no"', "true", "false", "1", "null", '{"a":1}']
    rows = [("eli", str(i), "<p>x</p>", "html", '{"title":"t","inForce":%s}' % f, "u") for i, f in enumerate(flags)] + [("eli", "7", "<p>x</p>", "html", '{"title":"t"}', "u"), ("eli", "8", "<p>x</p>", "html", "broken", "u")]
    raw = spark.createDataFrame(rows, "source string, external_id string, raw_content string, content_format string, payload string, source_url string")
    got = {r["external_id"]: r["in_force"] for r in normalize.normalize_acts(raw).collect()}
    assert [got[str(i)] for i in range(9)] == [True, False, True, False, None, None, None, None, None]
