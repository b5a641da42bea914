import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jurisgrid.llm import canonical, language, leakage, mixing, quality, scan_repair, skeleton


def test_skeleton_forms():
    s = skeleton.skeleton
    assert s("ＡＢ１") == s("AB1") and s("é") == s("é") and s("а​b\xa0c") == s("ab c") and s("ﬁn") == "fin" and s("a\r\nb  c ") == "a\nb c"
    assert s("l") != s("1") and s("O") != s("0") and s("é") != s("e") and s("x²") != s("x2") and s("a\nb") != s("a b")
    assert s("ΑТ") == "AT" and s("") == "" and s(" ​ ") == ""


def test_table_of_confusables():
    table = skeleton.prototypes()
    s = lambda t: skeleton.skeleton(t, table)
    assert s("ᏟᎪᏙ Ⲟ ᴜ") == "CAV O u" and s("Сour") == s("Cour") and s("х\U000e0041y\U000e0101") == "xy"
    for a, b in (("l", "1"), ("I", "l"), ("O", "0"), ("œ", "oe"), ("ß", "ss"), ("ı", "i"), ("é", "e"), ("–", "-")):
        assert s(a) != s(b)


def test_lookalike_pairs(spark):
    rows = [(1, "Cour d'appel é", 1, "x"), (2, "Сour d'аppel é", 1, "x"), (3, "Cour d'appel é", 1, "x"), (4, "Cour d'appel e", 1, "x"), (5, None, 1, "x"), (6, "", 1, "x"), (7, "  ", 1, "x"), (2, "Сour d'аppel é", 2, "x"), (None, "q", 1, "x"), (8, "z" * 200_000, 1, "x"), (9, "ｚ" + "z" * 199_999, 1, "x")]
    df = spark.createDataFrame(rows, "id long, text string, at int, class_id string")
    pairs = lambda d: sorted((r["a"], r["b"]) for r in skeleton.lookalike_pairs(skeleton.lookalike_classes(d, "id", "text", "at"), "id").collect())
    assert pairs(df) == [(1, 2), (2, 3), (8, 9)] and pairs(df.limit(0)) == []


def test_forms_of_both_columns(spark, tmp_path):
    from jurisgrid.llm.queries import QUERIES

    rows = [(1, "Сour d'аppel", "Cour d'appel", 1), (1, "Сour d'аppel", "Cour  d'appel", 2), (2, "ＡＢ", None, 1), (3, " ", "", 1)]
    spark.createDataFrame(rows, "extraction_id long, raw_text string, normalized_text string, n int").selectExpr("extraction_id", "raw_text", "normalized_text", "timestamp_seconds(n) as loaded_at").write.parquet(f"{tmp_path}/extractions.parquet")
    got = {r["extraction_id"]: r for r in QUERIES["p6_forms"](spark, str(tmp_path)).collect()}
    assert got[1]["raw_form"] == got[1]["normalized_form"] == "Cour d'appel" and got[1]["raw_class"] == got[1]["normalized_class"]
    assert got[2]["raw_form"] == "AB" and got[2]["normalized_form"] is None and got[2]["normalized_class"] is None and got[3]["raw_class"] is None and len(got) == 3


EN = "The parties agree that the renewal of the lease shall be governed by the rules of the court for the benefit of the lessee and it is not to be read as a waiver."
FR = "Les parties conviennent que le renouvellement du bail est régi par les règles de la cour au profit du preneur et ne peut pas être lu comme une renonciation."
DE = "Die Parteien vereinbaren, dass die Verlängerung des Vertrags nach den Regeln des Gerichts zugunsten der Mieter gilt und nicht als Verzicht auf das Recht zu lesen ist."


def test_language_segments(spark):
    docs = spark.createDataFrame([(i, t, lang, 0) for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de"), (None, "en"), ("x", None)] * 4)], "doc_id long, text string, lang string, w int")
    model = language.train(docs)
    text = "\n\n".join(["COUR D'APPEL DE LYON", EN, FR, EN, "Case No. 12/34", EN])
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, FR * 300), (5, "12 34"), (1, text)], "extraction_id long, body string")
    got = {r["extraction_id"]: r for r in language.label_languages(df, ["extraction_id"], "body", model).collect()}
    assert got[1]["main"] == "en" and [(s["no"], s["language"]) for s in got[1]["segments"]] == [(3, "fr")]
    assert got[2]["main"] is None and got[3]["main"] is None and got[5]["main"] is None and got[4]["main"] == "fr"
    fiches = spark.createDataFrame([(10, 1, "English"), (11, 1, "pt"), (12, 1, None), (13, 2, None), (14, 4, " fr-FR"), (15, None, "en")], "fiche_id long, extraction_id long, language string")
    found = language.wrong_labels(fiches, language.label_languages(df.distinct(), ["extraction_id"], "body", model))
    assert sorted((r["fiche_id"], r["segment_no"], r["language"]) for r in found.collect()) == [(10, 3, "fr"), (11, 0, "en"), (11, 3, "fr"), (12, 0, "en"), (12, 3, "fr")]
    assert language.label_languages(df.limit(0), ["extraction_id"], "body", model).count() == 0
    prior = language.train(docs.limit(0))
    assert language.label_texts([FR], {w: i for i, w in enumerate(prior[0])}, prior[1])[0][0] == "fr"


def test_scripts_and_spans_within_a_block(spark):
    assert language.candidates("straße") == {"de"} and language.candidates("lease") == set(language.LANGUAGES) and language.candidates("señora") == {"es"} and language.candidates("июль") == set()
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (FR, "fr"), (DE, "de")] * 4)], "doc_id long, text string, lang string")
    names, scores = language.train(docs)
    words = {w: i for i, w in enumerate(names)}
    assert scores[words["règles"]].argmax() == 1 and all(scores[words["règles"]][[0, 2, 3]] == -3)
    n = len(re.findall(r"[^\W\d_]+", EN))
    main, _, _, spans = language.label_texts([f"{EN}\n\n{EN} {FR}"], words, scores)[0]
    assert main == "en" and len(spans) == 1 and spans[0][0] == 2 and abs(spans[0][1] - n - 1) <= 1 and spans[0][3] == "fr" and spans[0][4] > 0.9
    assert language.label_texts([EN, ""], words, scores)[0][3] == []


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(6, 4)).astype("float32")
    for n in range(1, 6):
        code = rng.integers(0, 6, n).astype("int32")
        path = language._viterbi([code, code[:1]], scores, 1.5)[0]
        value = lambda p: sum(scores[c, s] for c, s in zip(code, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        best = max(value([(k // 4**i) % 4 for i in range(n)]) for k in range(4**n))
        assert abs(value(path) - best) < 1e-4


def test_held_out_language():
    pieces = [(t, lang) for t, lang in ((EN, "en"), (FR, "fr"), (DE, "de"))]
    words = {w: i for i, w in enumerate(sorted({w for ws in language.FUNCTION_WORDS.values() for w in ws}))}
    scores = np.array([[2.0 if w in language.FUNCTION_WORDS[x] else -0.5 for x in language.LANGUAGES] for w in words], "float32")
    assert [r[0] for r in language.label_texts([t for t, _ in pieces], words, scores)] == [x for _, x in pieces]


def test_words_without_latin_letters_are_no_evidence():
    words, scores = {"июль": 0, "lease": 1}, np.array([[-3, -3, 3, -3], [3, -3, -3, -3]], "float32")
    assert language.label_texts(["июль " * 20], words, scores)[0][0] is None
    assert language.label_texts(["lease " + "июль " * 20], words, scores)[0][0] == "en"


def test_foreign_blocks_of_nouns_and_names():
    """Sentences of which less than half is lower case, as German nouns and names are not."""
    sentences = [
        "Das Gericht verurteilt Pelsophar KG, an Wilsodatis AG entgegen Randnummer 52\n98.453 Euro zu zahlen.",
        "« Zansophar AG trägt vor, Braterbatec AG bemängelte die Besichtigung der Wasserrechte in Höhe von 298.885 Euro. »",
        "Das Gericht verurteilt Rasgarval AG, an Falterphar GmbH in Gegenwart zweier Zeugen 2.236 Euro zu zahlen.",
    ]
    names = ["LANDGERICHT HOHENWALDE, URTEIL DER ERSTEN KAMMER IN SACHEN PELSOPHAR", "Pelsophar KG, Wilsodatis AG, Zansophar AG, Braterbatec AG und Falterphar GmbH"]
    own = {lang: set(re.findall(r"[^\W\d_]+", t.lower())) | set(language.FUNCTION_WORDS[lang]) for lang, t in (("en", EN), ("fr", FR), ("de", DE + " ".join(sentences)), ("es", ""))}
    words = {w: i for i, w in enumerate(sorted(set.union(*own.values())))}
    scores = np.array([[2.0 if w in own[x] else -0.5 for x in language.LANGUAGES] for w in words], "float32")
    for main, text in (("en", EN), ("fr", FR)):
        got = language.label_texts(["\n\n".join([text, s, text, n, text]) for s in sentences for n in names], words, scores)
        assert [(r[0], [(no, lang) for no, lang, _ in r[2]]) for r in got] == [(main, [(2, "de")])] * len(got)
    assert language.label_texts(["\n\n".join([*sentences, EN])], words, scores)[0][0] == "de"


ENTRIES = [("court", 1, "Tribunal judiciaire d'Égrelle", "TJ Égrelle"), ("court", 2, "Cour d'appel d'Égrelle", None), ("court", 3, "Landgericht Hohenwalde", "LG Hohenwalde"), ("jurisdiction", 4, "Republic of Sarmatis", "SAR"), ("authority", 5, "Ministry of Justice of Valdoria", "MoJ Valdoria"), ("court", 6, None, None)]


def test_names(spark):
    cases = {
        ("court", "TRIBUNAL JUDICIARE D'EGRELE, 3e chambre"): 1, ("court", "tj  égrelle."): 1, ("court", "Égrelle, Cour d'appel d'"): 2, ("court", "Regional Court of Hohenwalde"): 3, ("court", "Tribunal judiciaire de Falvemaville"): -1,
        ("court", "Landgericht Égrelle"): -1, ("jurisdiction", "sar"): 4, ("jurisdiction", "SAT"): -1, ("jurisdiction", "the Republic of Sarmattis"): 4, ("jurisdiction", "Province of Nowhere"): -1, ("authority", "Valdoria - Ministry"): 5, ("authority", "see file"): -1, ("other", "x"): -1,
    }
    entries = spark.createDataFrame([(*e, 1) for e in ENTRIES], "kind string, entry_id long, entry_name string, short_name string, value int")
    rows = [(k, i, v) for i, (k, v) in enumerate(cases)] + [("court", 90, "Landgericht Hohenwalde"), ("court", 91, " Unknown "), ("court", 92, None), ("court", 93, "tj  égrelle."), ("court", 94, "y" * 5000)]
    records = canonical.free_entered(spark.createDataFrame(rows, "kind string, record_id long, value string"), entries)
    assert {r["record_id"] for r in records.collect()} == {*range(len(cases)), 93, 94}
    got = {(r["kind"], r["value"]): r["entry_id"] for r in canonical.match_names(records, entries).collect()}
    assert {k: got[k] for k in cases} == cases and got[("court", "y" * 5000)] == -1
    assert {r["entry_id"] for r in canonical.match_names(records, entries.limit(0)).collect()} == {-1} and canonical.match_names(records.limit(0), entries).count() == 0


def test_distances():
    assert canonical.typing_distance("egrelle", "egerlle", 2) == 1 and canonical.typing_distance("abc", "xyz", 2) == 3
    assert scan_repair.weighted_distance("documento", "docurnento") == 0.25 and scan_repair.weighted_distance("revisión", "rev!sión") == 0.25 and scan_repair.weighted_distance("garantía", "garantia") == pytest.approx(0.1)
    assert scan_repair.weighted_distance("tables", "cables") >= 1
    rng = random.Random(2)
    for _ in range(300):  # the index finds every single confusion
        good = "".join(rng.choice("acdefghilmnostuw") for _ in range(rng.randrange(4, 9)))
        a, b = rng.choice([c for c in scan_repair.CONFUSIONS if c[0] in good] or [("", "")])
        read = good.replace(a, b, 1) if a else good
        single = scan_repair.flat(read).translate(scan_repair._SINGLE)
        if not re.search("rn|ri|ii|ei|vv", good.translate(scan_repair._SINGLE)) and len(re.findall("(?=rn|ri|ii|ei|vv)", single)) <= (len(b) > 1):
            assert set(scan_repair.deletions(good)) & set(scan_repair.deletions(read)), (good, read)


def test_scan_noise(spark):
    clean = ["the supply contract is to be reviewed by the licensee", "the co-owner signed the document", "a co-owner"] * 15
    scanned = [
        (1, "HIGH COURT OF OXCLIFFE", []), (2, "Case No. 21/001234", []), (3, "The supply contract is to be review-\ned by the licensee.", ["hyphenation"]), (4, "- 2 -", ["furniture"]), (5, "HIGH COURT OF OXCLIFFE - Case No. 21/001234", ["furniture"]),
        (6, "The co-\nowner signed the docurnent", ["misread"]), (7, "The licen-", ["hyphenation"]), (8, "3/9\nsee signed the contract", ["furniture"]), (9, "The supply c0ntract is to be rev!ewed", ["misread"]), (10, "v.", []), (11, "", []), (12, None, []),
    ]
    rows = [(100 + i, 1, i, t, False) for i, t in enumerate(clean)] + [(i, 2, i, t, True) for i, t, _ in scanned] + [(50, None, None, "- 9 -", True)]
    noise = scan_repair.ScanNoise(spark.createDataFrame(rows, "unit_id long, extraction_id long, unit_order int, text string, scanned boolean"))
    got = {}
    for r in noise.found().collect():
        got.setdefault(r["unit_id"], []).append(r["noise"])
    assert {k: sorted(v) for k, v in got.items() if k != 50} == {i: ns for i, _, ns in scanned if ns}
    fixed = {r["unit_id"]: r["text"] for r in noise.repaired().collect()}
    assert fixed[3] == "The supply contract is to be reviewed by the licensee." and fixed[6] == "The co-owner signed the document" and fixed[7] == "The licensee" and fixed[8] == "signed the contract" and fixed[9] == "The supply contract is to be reviewed"
    empty = scan_repair.ScanNoise(spark.createDataFrame([], "unit_id long, extraction_id long, unit_order int, text string, scanned boolean"))
    assert empty.found().count() == 0


def test_running_headers_come_again(spark):
    """Whole opening lines and reference numbers that come again are headers; first occurrences and other lines that come again are not."""
    title = "COURT OF THE COMMERCIAL AND MARITIME MATTERS " * 9
    texts = [title.strip(), "Docket 17/00412", "FINDINGS", "The court read the lease.", title.strip() + " 2", "FINDINGS", "Maro / Tesk - Docket 17/OO412", "See 17/00412.", "The court read the lease."]
    rows = [(i, 1, i if i else None, t, True) for i, t in enumerate(texts, 1)] + [(100, 2, 5, title.strip(), True), (101, None, 1, "so it is", True)]
    noise = scan_repair.ScanNoise(spark.createDataFrame(rows, "unit_id long, extraction_id long, unit_order int, text string, scanned boolean"))
    assert sorted(r["unit_id"] for r in noise.furniture().collect()) == [5, 7]
    got = {r["paragraph"]: r["text"] for r in noise.paragraphs().where("extraction_id = 1").collect()}
    assert got[4] == "The court read the lease." and len(got) == 7


@pytest.mark.parametrize("trusted", [50_000, 0])
def test_misread_words_in_a_few_clean_files(spark, monkeypatch, trusted):
    """One clean file with the misread form changes nothing, nor does the list of trusted words."""
    monkeypatch.setattr(scan_repair, "TRUSTED", trusted)
    texts = [("the hearing of the lease was held", False)] * 200 + [("a liearing was held", False)] + [("the liearing and the hearing of the lease", True)] * 12
    noise = scan_repair.ScanNoise(spark.createDataFrame([(i, i, 1, t, s) for i, (t, s) in enumerate(texts)], "unit_id long, extraction_id long, unit_order int, text string, scanned boolean"))
    assert sorted(r["unit_id"] for r in noise.found().where("noise = 'misread'").collect()) == list(range(201, 213))
    assert {(r["word"], r["good"]) for r in noise.misread().collect()} == {("liearing", "hearing")}


@pytest.mark.parametrize("uses", [19, 25])
def test_rare_candidate_is_sought_among_trusted_words(spark, uses):
    """A name of 20 clean uses or more is a candidate where its document holds it, as one of fewer is."""
    texts = [(1, "the lease was signed by Domar", False)] * uses + [(2, "the lease of Domar", True), *[(2, "the lease was signed by Dornar", True)] * 3, (3, "the lease was signed by Dornar", True)]
    rows = [(i, e, i, t, s) for i, (e, t, s) in enumerate(texts)]
    noise = scan_repair.ScanNoise(spark.createDataFrame(rows, "unit_id long, extraction_id long, unit_order int, text string, scanned boolean"))
    assert sorted((r["unit_id"] - uses, r["noise"]) for r in noise.found().collect()) == [(i, "misread") for i in (1, 2, 3)]
    assert sorted((r["unit_id"] - uses, r["word"], r["good"]) for r in noise.misread().collect()) == [(i, "dornar", "domar") for i in (1, 2, 3)]


def test_leaks(spark):
    rng = random.Random(4)
    item = " ".join(f"word{rng.randrange(50)}x" if i % 5 else str(i) for i in range(40)).replace("word7x", "Élan")
    words = item.split()
    docs = [
        (1, "Intro. " + ", ".join(words[3:23]).upper() + " end"), (2, " ".join(words[3:22])), (3, " ".join(words)), (4, None), (5, ""), (6, "x " * 50_000 + " ".join(words[10:30])), (3, " ".join(words)),
        (7, " ".join(w if not w.isdigit() else str(900 + int(w)) for w in words)), (None, item),
    ]
    items = spark.createDataFrame([(1, item, "e"), (2, None, "e"), (3, "too short", "e")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["how"]) for r in leakage.find_leaks(df, items).collect())
    assert got == [(1, 1, "exact"), (3, 1, "exact"), (6, 1, "exact"), (7, 1, "template")]
    assert leakage.find_leaks(df.limit(0), items).count() == 0 and leakage.find_leaks(df, items.limit(0)).count() == 0


def test_reworked_items_of_other_length(spark):
    """Changed numbers, names and units with another count of words."""
    item = "The court of the city then orders that Villarrosal must pay within 25 days 643 euro for Villarrosal and the lessee of the house it has"
    other = "so that it is of no use to a party in the case if the rules of the act are not read as they are"

    def change(*pairs):
        text = item
        for a, b in pairs:
            text = text.replace(a, b)
        return text

    name = ("Villarrosal", "Kelvemolux Nord GmbH")
    same = [change(("643", "49.845")), change(name), change(name, ("643", "1 200,50"), ("25 days", "3 weeks")), change(("643 euro", "1.200 €")), change(("643 euro", "12,000 dollars"))]
    none = [change(("25 days", "25 euro")), change(("for Villarrosal", "for Jasquilux Nord"), ("that Villarrosal", "that Kelvemolux")), change(("within", "not at all in")), change(("643", "such"))]
    texts = [item, *("Before. " + t + " After." for t in same), *none]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    found = lambda **k: sorted((r["doc_id"], r["item_id"], r["how"]) for r in leakage.find_leaks(docs, items, **k).collect())
    assert found() == [(0, 1, "exact"), *((n, 1, "template") for n in range(1, len(same) + 1))]
    assert found(reworked=False) == [(0, 1, "exact")]


def test_slots_and_filters(spark):
    """Slots stand for one value each way; a text of names fits no template; other items don't change a pair."""
    item = "the court of Nerac and the court of Agen find that the lease of the house is void since Nerac has paid for it"
    swapped = item.replace("Agen", "Nerac")  # two values become one
    names, others = " ".join(f"Alpha{i}" for i in range(30)), " ".join(f"Beta{i}" for i in range(30))
    docs = spark.createDataFrame([(1, item.replace("Nerac", "Foix")), (2, swapped), (3, others), (4, names)], "doc_id long, text string")
    items = [(1, item), (2, names)]
    found = lambda rows: sorted((r["doc_id"], r["item_id"], r["how"]) for r in leakage.find_leaks(docs, spark.createDataFrame(rows, "item_id long, text string")).collect())
    assert found(items) == [(1, 1, "template"), (4, 2, "exact")]
    assert [x for x in found([*items, *((10 + i, f"{item} {i} " * 3 + names.lower().replace("alpha", f"zeta{i}")) for i in range(30))]) if x[1] < 3] == found(items)


def test_mix(spark):
    docs = [(i, "one two three " * (1 + i % 5), "a" if i % 3 == 0 else "b") for i in range(120)] + [(900, None, "a"), (901, "", "b"), (902, "w x", None), (903, "q r s", "extra"), (904, "u v", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("ghost", 0.2, 3)], "source string, target_share double, max_repeats int")
    taken, report = mixing.mix(df, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["ghost"]["taken"] == 0 and rows["extra"]["taken"] == 0 and rows[None]["taken"] == 0 and rows[None]["available"] > 0
    assert rows["a"]["repeats"] <= 2 and rows["b"]["repeats"] <= 1 and rows["a"]["taken"] == rows["a"]["budget"] and rows["b"]["taken"] == rows["b"]["budget"]
    assert abs(rows["a"]["actual_share"] - 0.625) < 0.01
    got = taken.collect()
    for s in ("a", "b"):
        assert sum(r["take"] for r in got if r["source"] == s) == rows[s]["budget"] and sum(r["take"] < r["tokens"] for r in got if r["source"] == s) <= 1
    small = {r["source"]: r["taken"] for r in mixing.mix(df, targets, total_tokens=80)[1].collect()}
    assert small["a"] == 50 and small["b"] == 30
    assert mixing.mix(df.limit(0), targets)[0].count() == 0
    enc = df.where("doc_id < 3").select(mixing.token_counter()(F.col("text"))).collect()
    assert all(r[0] > 0 for r in enc)


def test_quality(spark):
    prose = (EN + " ") * 5
    junk = {"list": "\n".join(f"- the review of the lease {i}" for i in range(30)), "table": "\n".join("Oxcliffe;12;-;45 %;9.1" for _ in range(30)), "signs": "#}~}§+ ^= [<++_{|} >=>! " * 20, "index": "\n".join(f"The review of the lease ........ {i}" for i in range(30))}
    docs = [(i, prose + f" Number {i}.", "en") for i in range(60)] + [(100 + i, t, "en") for i, t in enumerate(junk.values())]
    docs += [(200, prose.upper(), "en"), (201, re.sub(r"((?:\S+ ){9})", r"\1\n", prose), "en"), (202, prose + "\n\n" + "\n".join("- a lease" for _ in range(4)), "en"), (203, None, "en"), (204, "", None), (205, "1;2;3\n" * 30, None), (205, "1;2;3\n" * 30, None), (206, prose * 300, "xx")]
    out = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("words", F.lit("clash")))
    flagged = sorted(r["doc_id"] for r in out.where("flagged").collect())
    assert [d for d in flagged if d < 200] == [100, 101, 102, 103] and not {200, 201, 202, 203, 204, 206} & set(flagged)
    assert all(r["tails"] > 0 for r in out.where("flagged").collect()) and out.where("doc_id = 0").first()["tails"] == 0
    row = out.where("doc_id = 0").first()
    assert row["words"] == len(EN.split()) * 5 + 1 and 0 <= row["pct_words"] <= 1
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_quality_of_much_junk(spark):
    """Junk that is a third of a language, or all of it, is still junk."""
    prose, table, listing = (EN + " ") * 5, "\n".join("Oxcliffe;12;-;45 %;9.1" for _ in range(30)), "\n".join(f"- the review of the lease {i}" for i in range(30))
    docs = [(i, prose + f" Number {i}.", "en") for i in range(65)] + [(100 + i, (table, listing)[i % 2], "en") for i in range(35)] + [(200 + i, table, "de") for i in range(9)] + [(300, "", "de")]
    out = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert sorted(r["doc_id"] for r in out.where("flagged").collect()) == [*range(100, 135), *range(200, 209)]
