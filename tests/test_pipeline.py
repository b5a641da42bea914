import re

from pyspark.sql import functions as F

from jurisgrid.functions import numbers, registry, text
from jurisgrid.operators import detection, fiche, identity, parsing
from jurisgrid.sources import files


def col(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    got = col(spark, lambda c: numbers.normalize_number(c, "fr"), "1er", "77 bis", "IV", "12-15", "5a", "(c)", "12345", "", None, "3.", "deuxième")
    assert got == ["0001", "0077-BIS", "0004", "0012-0015", "0005a", "(C)", "12345", "0000", "0000", "0003", "0002"]
    assert col(spark, numbers.roman_to_int, "MCMXCIV", "iv", "IIII", "", "XLII") == [1994, 4, None, None, 42]
    assert col(spark, numbers.sort_key, "ART-0001-BIS", "ART-0001-QUATER", "ART-0001-DECIES", "ART-0002") == ["ART-0001-0998", "ART-0001-QUA0999", "ART-0001-1006", "ART-0002"]


def test_normalisers(spark):
    assert col(spark, text.normalize_core, "a\r\nb ​c  d \n\n\n\n e ", None) == ["a\nb c d\n\ne", None]
    assert col(spark, text.normalize_detector, "ﬁn “x” – y… Artic1e") == ['fin "x" - y... Article']
    assert col(spark, text.normalize_extractor, "  a \n b\t\tc ") == ["a\nb c"]
    assert col(spark, lambda c: text.slugify(c, 10), "Élan & Co. — x y z", None) == ["elan-co-x-", None]
    assert col(spark, lambda c: text.preview(c, 12), "short", "several words here") == ["short", "several word..."]
    s = "xx Article 1 yy Article 22 z"
    assert col(spark, lambda c: text.starts_of(c, r"Article \d+"), s, "none") == [[m.start() for m in re.finditer(r"Article \d+", s)], []]


def test_language_and_types(spark):
    docs = spark.createDataFrame([
        (1, "The rights of the people and this court, with which the article of the law shall apply."), (2, None), (3, ""),
        (4, "COUR D'APPEL DE LYON\nARRÊT DU 3 mai 2001\nN° RG 12/00012\n" + "Faits et procédure. " * 10 + "PAR CES MOTIFS rejette."),
        (5, "REGULATION (EU) 2016/679 of the European Parliament and of the Council\nWhereas:\n" + "\n".join(f"Article {i}\nText {i}" for i in range(1, 40)) + "\nThis Regulation shall be binding in its entirety and directly applicable."),
    ], "doc_id long, text string")
    lang = {r[0]: r[1] for r in docs.select("doc_id", detection.detect_language(F.col("text"))).collect()}
    assert lang[1] == "en" and lang[2] == lang[3] == "unknown"
    hits = detection.scan_signals(docs)
    routed = {r["doc_id"]: r for r in detection.route(detection.decide(docs, detection.score_types(hits))).collect()}
    assert len(routed) == 5
    assert routed[4]["type"] == "judgment" and routed[4]["reason"] == "auto" and routed[5]["type"] == "regulation"
    assert routed[2]["decision"] == "unknown" and routed[2]["warning"] == "GENERIC_ROUTING" and routed[2]["parser"] == "unknown"
    assert detection.dimensions(docs.limit(1).select("doc_id", F.lit("statute").alias("type"))).first()["origin"] == "legislative"
    assert len(registry.SIGNALS) == 52 and len({s[1] for s in registry.SIGNALS}) == 52


def test_structure(spark):
    body = "CHAPTER I\nGeneral\nArticle 1\nScope of this text, see Article 2 and Section 9.\nArticle 2\nTerms used in this text are defined here.\nCHAPTER II\nArticle 3\nLast words of the whole text, in short."
    docs = spark.createDataFrame([(1, body, "en", "regulation"), (2, None, "en", "regulation"), (3, "", "xx", "judgment"), (4, "FACTS\n1. One word of the facts.\nREASONING\n[2] Two words of the reasons.", "en", "judgment"), (1, body, "en", "regulation")], "doc_id long, text string, lang string, kind string")
    parsed = parsing.parse_documents(docs.withColumn("elements", F.lit(1)))
    assert parsed.count() == 5 and parsed.where("doc_id in (2, 3) and status = 'empty' and size(elements) = 0").count() == 2 and parsing.parse_documents(docs.limit(0)).count() == 0
    rows = {(r["doc_id"], r["id"]): r for r in fiche.unfold(parsed, "elements").collect()}
    at = lambda k: rows[(1, k)]["position"]
    assert rows[(1, "ART-0002")]["tree_parent"] == at("CH-0001") and rows[(1, "ART-0003")]["tree_parent"] == at("CH-0002") == body.index("CHAPTER II")
    assert rows[(1, "CH-0001")]["end_position"] == at("CH-0002") and rows[(1, "ART-0001")]["content"].startswith("Scope") and rows[(1, "CH-0001")]["children"] == 2
    refs = {(r["source_id"], r["target_id"]): r for r in fiche.unfold(parsed, "refs").where("doc_id = 1").collect()}
    assert set(refs) == {("ART-0001", "ART-0002"), ("ART-0001", "SEC-0009")}  # not again for the chapter around the article
    assert refs[("ART-0001", "ART-0002")]["resolved"] and not refs[("ART-0001", "SEC-0009")]["resolved"]
    assert fiche.provisions(parsed).where("doc_id = 1 and id = 'ART-0002'").first()["incoming"] >= 1
    linked = {r["id"]: r["section_role"] for r in fiche.unfold(parsed, "elements").where("doc_id = 4").collect()}
    assert linked["PARA-0001"] == "facts" and linked["PARA-0002"] == "reasoning"
    kinds = {r["type"]: r["source_ids"] for r in fiche.unfold(parsed, "relations").where("doc_id = 4").collect()}
    assert kinds["facts-reasoning-link"] == ["PARA-0001"]
    assert {r["label"] for r in fiche.document_map(parsed).where("doc_id = 4").collect()} >= {"FACTS", "REASONING"}


def test_forms_by_language():
    act = parsing.parse("LOI\n\nTitre I\nDispositions\n\nChapitre 2\nArticle 3 bis\nLe présent article renvoie à l'article 12 bis de la loi.\nANNEXE II\nTableau des taux", "statute", "fr")
    assert [e["id"] for e in act["elements"]] == ["TITLE-0001", "CH-0002", "ART-0003-BIS", "ANNEX-0002"] and any(r["target_id"] == "ART-0012-BIS" for r in act["refs"])
    german = parsing.parse("Gesetz über Fristen\nAbschnitt I\nAllgemeines\n(1) Die Frist beginnt mit der Zustellung des Urteils.\n(2) Sie endet nach einem Monat.", "statute", "de")
    assert [(e["type"], e["level"]) for e in german["elements"]] == [("SEC", 1), ("SUBSEC", 3), ("SUBSEC", 3)]
    lease = parsing.parse("LEASE AGREEMENT\nbetween Alma Ltd and Bor plc.\nWHEREAS the parties wish to let a house.\nClause 1 Term\nThe term is two years, see Schedule A.\nClause 2 Law\nThe governing law is that of the place.\nSchedule A\nThe house with its garden and the shed.\nSIGNED by both parties\nClause 9 Not one", "contract", "en")
    assert [e["id"] for e in lease["elements"]] == ["CL-0001", "CL-0002", "SCHEDULE-A"] and lease["parties"] == ["Alma Ltd", "Bor plc"] and [s["detail"] for s in lease["signals"]] == ["governing-law"]
    assert {b["key"] for b in lease["blocks"]} == {"recitals", "signatures"} and lease["metadata"]["contract_type"] == "LEASE AGREEMENT" and lease["elements"][0]["citation"] == "Clause 1, LEASE AGREEMENT"
    plain = parsing.parse("One block of words here.\n\nAnother block of words.", "unknown", "en")
    assert [e["id"] for e in plain["elements"]] == ["BLOCK-0001", "BLOCK-0002"] and plain["status"] == "no-structure" and "GENERIC_PARSER_USED" in plain["warnings"]
    us = parsing.parse("We the People of the United States, in Order to form a more perfect Union, do ordain and establish this Constitution for the United States of America.\nArticle I\nSection 1. All legislative Powers are vested in a Congress. Section 2. The House is chosen every second Year.\nArticle II\nSection 1\nThe executive Power is vested in a President.\nArticle III\nThe judicial Power is vested in one Court.", "constitution", "en")
    assert us["metadata"]["reference"] == "US-CONST" and [e["id"] for e in us["elements"]] == ["ART-0001", "ART-0001-SEC-0001", "ART-0001-SEC-0002", "ART-0002", "ART-0002-SEC-0001", "ART-0003"]
    assert us["blocks"][0]["type"] == "PREAMBLE" and us["elements"][1]["parent_id"] == "ART-0001"


def test_judgments():
    text = """Cour de cassation - Assemblée plénière
Arrêt du 2 juin 2000
N° de pourvoi : 99-60.274
Publié au bulletin
Décision attaquée : Tribunal de première instance de Nouméa, 1999-05-03
Sur le premier moyen et sur le second moyen réunis :
Attendu que Mlle Farand fait grief au jugement attaqué d'avoir rejeté sa requête alors, selon le moyen : 1° que l'article 188 de la loi organique est contraire ; 2° que le traité de l'Union européenne prime
Mais attendu, d'abord, que le droit est clair et que la règle est posée
D'où il suit que les moyens ne sont pas fondés
PAR CES MOTIFS :
REJETTE le pourvoi."""
    p = parsing.parse(text, "judgment", "fr")
    assert {e["id"] for e in p["elements"]} >= {"ISSUES", "CLAIMS", "REASONING-1", "CONCLUSION", "DISPOSITION", "ORDER"} and all(not e["is_empty"] for e in p["elements"] if e["type"] != "SECT")
    m = p["metadata"]
    assert (m["court"], m["case_number"], m["judgment_date"], m["formation"], m["publication_status"], m["outcome"], m["jurisdiction"]) == ("Cour de cassation", "99-60.274", "2 juin 2000", "Assemblée plénière", "Publié au bulletin", "Rejette", "France")
    assert m["title"] == "Cour de cassation - Assemblée plénière - 2 juin 2000 - pourvoi n° 99-60.274" and m["lower_court"].startswith("Tribunal")
    claims = [s for s in p["signals"] if s["kind"] == "claim"]
    assert [c["id"] for c in claims] == ["CLAIM-1", "CLAIM-2"] and any(s["kind"] == "authority" and s["detail"] == "eu-treaty" for s in p["signals"])
    english = parsing.parse("JUDGMENT OF THE COURT\nAlma Ltd v Bor plc\nCase C-12/34\nFacts\n1. The facts rest on REGULATION (EU) 2016/679 and Article 5.\nReasoning\n2. The court considers paragraph 1.\nConclusion\n3. For these reasons the appeal is dismissed.", "judgment", "en")
    assert {(c["kind"], c["owner_id"]) for c in english["citations"]} >= {("eu-law-citation", "PARA-0001"), ("case-citation", None)} and english["metadata"]["court"] == "JUDGMENT OF THE COURT" and english["metadata"]["case_number"] == "C-12/34"
    assert any(b["key"] == "disposition" and b["id"] == "SECT-CONCLUSION" for b in english["blocks"]) and english["blocks"][0]["type"] == "HEADER" and not english["warnings"]
    assert ("PARA-0002", "PARA-0001", True) in {(r["source_id"], r["target_id"], r["resolved"]) for r in english["refs"]}


def test_extents_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(200):
        text, elements = "x" * 400, []
        for at in sorted(rng.sample(range(0, 390), rng.randrange(1, 14))):
            level = rng.choice([-1, 0, 0, 1, 2, 3, 9])
            elements.append(parsing._element(rng.choice("AB"), level, "1", "1", f"I{at}", at, 0, "x"))
        parsing.set_extents(text, elements)
        parsing.set_tree(elements)
        for i, e in enumerate(elements):
            end = next((n["position"] for n in elements[i + 1 :] if 0 <= n["level"] <= e["level"] or (n["type"], n["level"]) == (e["type"], e["level"])), len(text))
            parent = next((n["position"] for n in reversed(elements[:i]) if n["level"] < e["level"]), None)
            assert (e["end_position"], e["tree_parent"]) == (end, parent)


def test_signals_with_places():
    text = "Article 1\n" + "Some words of the body. " * 40 + "\nMember States shall transpose this."
    got = {h[1]: h for h in detection.find_signals(text)}
    assert got["transposition_language"][5] == [text.index("transpose")] and got["transposition_language"][6][0].startswith("Some words") is False and "transpose this" in got["transposition_language"][6][0]
    assert detection.needed_words(r"\\bMember\\s+States?\\s+shall\\b".replace("\\\\", "\\")) == ["member", "state", "shall"] and detection.needed_words("alpha|beta") == []


def test_identity_and_duplicates(spark):
    assert identity._hash("") == "488bdcb81aee8d83" and identity._hash("Article 1") == "28a1d007bf68cf5d" and identity._hash("é") == "d9fefd8451e926d5"
    cols = "id long, ord long, fingerprint string, canonical_id string, reference string, title string"
    lib = spark.createDataFrame([(1, 1, "f1", "c1", "Unknown", "A long title about the supply of grain"), (2, 2, "f2", "c2", "R2", None)], cols)
    new = spark.createDataFrame([(11, 1, "f2", "x", "R9", "z"), (12, 1, "y", "y", "unknown", "q"), (13, 1, "n", "n", "n", "a long title about the supply of the grain"), (14, 1, None, None, None, None)], cols)
    got = {r["new_id"]: (r["library_id"], r["reason"]) for r in identity.first_duplicates(new, lib).collect()}
    assert got == {11: (2, "fingerprint"), 12: (1, "reference"), 13: (1, "similar-title")}


def test_identity_of_parsed_documents(spark):
    rows = [(1, "judgment", {"court": "Tribunal administratif", "case_number": "12/34", "judgment_date": "3 mai 2001", "title": "x"}, "a_b.txt", "Un texte sur la France. " * 20), (2, "contract", {"title": "Lease"}, None, ""), (3, "unknown", {}, "my-file.txt", None)]
    got = {r["id"]: r for r in identity.build_identity(spark.createDataFrame(rows, "id long, kind string, metadata map<string,string>, file string, body string"), "body", "kind", "metadata", "file").collect()}
    assert got[1]["display_title"] == "Tribunal administratif - 12/34 - 3 mai 2001" and got[1]["short_title"] == "TA - 12/34 - 2001" and got[1]["jurisdiction"] == "France" and got[1]["identity_confidence"] == 100 and not got[1]["identity_warnings"]
    assert got[1]["canonical_id"].startswith("judgment-france-tribunal-administratif-3-mai-2001-12-34-") and got[1]["canonical_id"].endswith(got[1]["fingerprint"][:10])
    assert got[2]["display_title"] == "Lease" and got[2]["identity_confidence"] == 20 and "IDENTITY_EMPTY_TEXT" in got[2]["identity_warnings"] and got[3]["display_title"] == "Legal Document"
    texts = ["", "a", "Article 1", "é", "😀 x"] * 20
    assert identity._hash_many(texts) == [identity._hash(t) for t in texts]


def test_search_and_warnings(spark):
    df = spark.createDataFrame([(1, "a <b> Court"), (2, None)], "extraction_id long, title string")
    assert fiche.search(df, " court ", "title").count() == 1 and fiche.search(df, " ", "title").count() == 2
    assert df.select(fiche.highlight(F.col("title"), "court")).first()[0] == "a &lt;b&gt; <mark>Court</mark>"
    ext = spark.createDataFrame([(1, None, "", "x" * 60, "m")], "extraction_id long, filename string, raw_text string, normalized_text string, extraction_method string")
    assert {r["code"] for r in fiche.validate_extraction(ext).collect()} == {"VALIDATION_REQUIRED_FIELD", "VALIDATION_RAW_TEXT_MISSING"}


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes("Héllo\r\n\r\nworld".encode("utf-16"))
    (src / "b.html").write_text("<h1>T</h1><script>x</script><p>One <b>two</b></p><table><tr><td>a</td><td>b</td></tr></table>", encoding="utf-8")
    (src / "c.pdf").write_bytes(b"%PDF")
    (src / "d.txt").write_bytes(b"bad \xff byte")
    rows = {r["filename"]: r for r in files.read_files(spark, str(src)).collect()}
    assert rows["a.txt"]["raw_text"] == "Héllo\r\n\r\nworld" and rows["a.txt"]["encoding"] == "utf-16-le" and rows["a.txt"]["normalized_text"] == "Héllo\n\nworld"
    assert rows["c.pdf"]["status"] == "failed" and rows["c.pdf"]["warning"] == "PDF_NOT_IMPLEMENTED" and "�" in rows["d.txt"]["raw_text"]
    html = files.read_files(spark, str(src)).where("extension = 'html'")
    assert html.first()["raw_text"] == "T\n\nOne two\n\na | b" and html.first()["units"] == 3 and html.first()["words"] == 6
    units = files.units_of_html(html, "filename", "markup").orderBy("unit_order").collect()
    assert [(u["type"], u["text"]) for u in units] == [("heading", "T"), ("paragraph", "One two"), ("table-row", "a | b")]
    text_units = files.units_of_text(spark.createDataFrame([(1, "A\n\n\nA\n\n B \n\n"), (2, None), (3, "")], "k long, t string"), "k", "t").collect()
    assert [(u["k"], u["unit_order"], u["text"]) for u in text_units] == [(1, 1, "A"), (1, 2, "B")]
    layout = '<meta name="generator" content="pdf2htmlEX"><div id="pf1" data-page-no="1"><div class="t">The C o uncil and Parliamen t</div><div class="t">..</div></div><div id="pf2" data-page-no="2"><div class="t m">may appointan Agent , too</div></div>'
    assert files.html_blocks(layout) == ("pdf-layout", [("", "The Council and Parliament", "1"), ("", "may appoint an Agent, too", "2")])
    from jurisgrid.streaming.ingest import start, stream_files, stream_units

    units_in = tmp_path / "units"
    spark.createDataFrame([("2024-01-01 10:00:00", "A"), ("2024-01-01 11:00:00", "A"), ("2024-01-09 10:00:00", "B")], "at string, feed_code string").selectExpr("to_timestamp(at) as loaded_at", "feed_code").write.parquet(str(units_in))
    stream = stream_units(spark.readStream.schema("loaded_at timestamp, feed_code string").parquet(str(units_in)))
    q = stream.selectExpr("w.start as day", "feed_code", "units").writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cu")).start()
    q.awaitTermination(120)
    assert {(r["feed_code"], r["units"]) for r in spark.table("counted").collect()} == {("A", 2), ("B", 1)}
    files.write_table(rows_ := files.read_files(spark, str(src)).drop("markup"), str(tmp_path / "sink"), "status")
    assert spark.read.parquet(str(tmp_path / "sink")).count() == rows_.count() == 4

    (src / "e.txt").write_bytes("Héllo\n\nworld".encode())
    q = start(stream_files(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'extracted'").count() == 3
