"""Fixed values of document structure: headings, references, blocks and metadata by document type and language.

Every table is keyed by type and language and read from top to bottom; the first form that fits decides. Letter case does not
count unless a table says so. Values that results depend on stand here and nowhere else.
"""

from __future__ import annotations

BIS = r"(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies))?"
TER = r"(?:\s*(?:bis|ter|quater))?"
RANGE = r"(?:[-–—](?:\d{1,4}|[A-Za-z]+))?"

# Headings of elements: (element, level, form with the identifier as group 1, or the last group for constitutions).
HEADINGS: dict[str, dict[str, list[tuple[str, int, str]]]] = {
    "constitution": {
        "en": [
            ("PREAMBLE", -1, r"\b(Preamble)\b"), ("PART", 0, r"\bPart\s+([IVXLCDM]+|\d+)\b\.?"), ("SCHEDULE", 0, r"\bSchedule\s+([IVXLCDM]+|\d+)\b\.?"), ("AMEND", 0, r"\bAmendment\s+([IVXLCDM]+|\d+)\b\.?"),
            ("TITLE", 1, r"\bTitle\s+([IVXLCDM]+|\d+)\b\.?"), ("CH", 2, r"\bChapter\s+([IVXLCDM]+|\d+)\b\.?"), ("SEC", 3, r"\bSection\s+(\d+[A-Za-z]?)\b\.?"),
            ("ART", 4, r"\bArticle\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?" + RANGE + BIS + r")\b\.?"), ("CL", 5, r"\bClause\s+(\d+[A-Za-z]?)\b\.?"),
        ],
        "fr": [
            ("PREAMBLE", -1, r"\b(Préambule|Preambule)\b"), ("PART", 0, r"\bPartie\s+([IVXLCDM]+|\d+)\b\.?"), ("TITLE", 1, r"\bTitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b\.?"),
            ("CH", 2, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b\.?"), ("SEC", 3, r"\bSection\s+(\d+[A-Za-z]?)\b\.?"), ("ART", 4, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + BIS + r")\b\.?"),
        ],
        "de": [
            ("PREAMBLE", -1, r"\b(Präambel|Praambel)\b"), ("TITLE", 1, r"\bTitel\s+([IVXLCDM]+|\d+)\b\.?"), ("CH", 2, r"\bKapitel\s+([IVXLCDM]+|\d+)\b\.?"), ("SEC", 3, r"\bAbschnitt\s+([IVXLCDM]+|\d+)\b\.?"),
            ("ART", 4, r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b\.?"),
        ],
        "es": [
            ("PREAMBLE", -1, r"\b(Preámbulo|Preambulo)\b"), ("PART", 0, r"\bParte\s+([IVXLCDM]+|\d+)\b\.?"), ("TITLE", 1, r"\b(?:Título|Titulo)\s+([IVXLCDM]+|\d+)\b\.?"),
            ("CH", 2, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b\.?"), ("SEC", 3, r"\b(?:Sección|Seccion)\s+(\d+[A-Za-z]?)\b\.?"), ("ART", 4, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b\.?"),
        ],
    },
    "regulation": {
        "en": [("CH", 0, r"\bChapter\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\bArticle\s+(\d{1,4}[A-Za-z]?" + RANGE + BIS + r")\b"), ("ANNEX", 0, r"\bAnnex\s+([IVXLCDM]+|\d+)\b")],
        "fr": [("CH", 0, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"), ("SEC", 1, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + BIS + r")\b"), ("ANNEX", 0, r"\bAnnexe\s+([IVXLCDM]+|\d+)\b")],
        "de": [("CH", 0, r"\bKapitel\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\bAbschnitt\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b"), ("ANNEX", 0, r"\bAnhang\s+([IVXLCDM]+|\d+)\b")],
        "es": [("CH", 0, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\b(?:Sección|Seccion)\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b"), ("ANNEX", 0, r"\bAnexo\s+([IVXLCDM]+|\d+)\b")],
    },
    "directive": {
        "en": [("CH", 0, r"\bChapter\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\bArticle\s+(\d{1,4}[A-Za-z]?" + RANGE + TER + r")\b"), ("ANNEX", 0, r"\bAnnex\s+([IVXLCDM]+|\d+)\b")],
        "fr": [("CH", 0, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"), ("SEC", 1, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + TER + r")\b"), ("ANNEX", 0, r"\bAnnexe\s+([IVXLCDM]+|\d+)\b")],
        "de": [("CH", 0, r"\bKapitel\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\bAbschnitt\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b"), ("ANNEX", 0, r"\bAnhang\s+([IVXLCDM]+|\d+)\b")],
        "es": [("CH", 0, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\b(?:Sección|Seccion)\s+(\d+[A-Za-z]?)\b"), ("ART", 2, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b"), ("ANNEX", 0, r"\bAnexo\s+([IVXLCDM]+|\d+)\b")],
    },
    "treaty": {
        "en": [
            ("PART", 0, r"\bPart\s+([IVXLCDM]+|\d+)\b"), ("PROTOCOL", 0, r"\bProtocol\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("TITLE", 1, r"\bTitle\s+([IVXLCDM]+|\d+)\b"), ("CH", 2, r"\bChapter\s+([IVXLCDM]+|\d+)\b"),
            ("SEC", 2, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ART", 3, r"\bArticle\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?" + RANGE + TER + r")\b"), ("ANNEX", 0, r"\bAnnex\s+([IVXLCDM]+|\d+|[A-Z])\b"),
        ],
        "fr": [
            ("PART", 0, r"\bPartie\s+([IVXLCDM]+|\d+)\b"), ("PROTOCOL", 0, r"\bProtocole\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("TITLE", 1, r"\bTitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"), ("CH", 2, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"),
            ("ART", 3, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + TER + r")\b"), ("ANNEX", 0, r"\bAnnexe\s+([IVXLCDM]+|\d+|[A-Z])\b"),
        ],
        "de": [("PART", 0, r"\bTeil\s+([IVXLCDM]+|\d+)\b"), ("PROTOCOL", 0, r"\bProtokoll\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("TITLE", 1, r"\bTitel\s+([IVXLCDM]+|\d+)\b"), ("CH", 2, r"\bKapitel\s+([IVXLCDM]+|\d+)\b"), ("ART", 3, r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b")],
        "es": [
            ("PART", 0, r"\bParte\s+([IVXLCDM]+|\d+)\b"), ("PROTOCOL", 0, r"\bProtocolo\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("TITLE", 1, r"\b(?:Título|Titulo)\s+([IVXLCDM]+|\d+)\b"), ("CH", 2, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b"),
            ("ART", 3, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b"),
        ],
    },
    "statute": {
        "en": [
            ("PART", 0, r"\bPart\s+([IVXLCDM]+|\d+)\b"), ("SCHEDULE", 0, r"\bSchedule\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("DIV", 1, r"\bDivision\s+([IVXLCDM]+|\d+)\b"), ("SEC", 2, r"\bSection\s+(\d+[A-Za-z]?(?:\.\d+)?)\b"),
            ("SEC", 2, r"^\s*(\d+[A-Za-z]?(?:\.\d+)?)\.\s+(.+)$"), ("SUBSEC", 3, r"^\s*\((\d{1,3}[a-z]?)\)\s+(.+)$"), ("PARA", 4, r"^\s*\(([a-z])\)\s+(.+)$"), ("SUBPARA", 5, r"^\s*\(([ivxlcdm]+)\)\s+(.+)$"),
        ],
        "fr": [
            ("PART", 0, r"\bPartie\s+([IVXLCDM]+|\d+)\b"), ("TITLE", 1, r"\bTitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"), ("CH", 1, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"),
            ("ART", 2, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + TER + r")\b"), ("SEC", 2, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("ANNEX", 0, r"\bAnnexe\s+([IVXLCDM]+|\d+)\b"),
        ],
        "de": [("PART", 0, r"\bTeil\s+([IVXLCDM]+|\d+)\b"), ("SEC", 1, r"\bAbschnitt\s+([IVXLCDM]+|\d+)\b"), ("SEC", 2, r"\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("SUBSEC", 3, r"^\s*\((\d{1,3}[a-z]?)\)\s+(.+)$")],
        "es": [("TITLE", 1, r"\b(?:Título|Titulo)\s+([IVXLCDM]+|\d+)\b"), ("CH", 1, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b"), ("ART", 2, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b"), ("ANNEX", 0, r"\bAnexo\s+([IVXLCDM]+|\d+)\b")],
    },
    "judgment": {
        "en": [
            ("SECT", 0, r"^\s*(Facts|Background|Procedural\s+History|Legal\s+Context|Issues|Questions?\s+Presented|Reasoning|Analysis|Discussion|Findings|Conclusion|Disposition|Holding|Order|Costs)\s*$"),
            ("PARA", 2, r"^\s*\[(\d{1,4})\]\s+(.+)$"), ("PARA", 2, r"^\s*(\d{1,4})\.\s+(.+)$"), ("SUBPARA", 3, r"^\s*\(([a-z]|[ivxlcdm]+)\)\s+(.+)$"),
        ],
        "fr": [
            ("SECT", 0, r"^\s*((?:Faits(?:\s+et\s+proc[ée]dure)?|Expos[ée]\s+du\s+litige|Rappel\s+des\s+faits|Contexte|Proc[ée]dure|Moyens|Pr[ée]tentions(?:\s+des\s+parties)?|Discussion|Motivation|Motifs(?:\s+de\s+la\s+d[ée]cision)?|Sur\s+ce|Dispositif|Par\s+ces\s+motifs|D[ée]pens))\s*[:,]?\s*$"),
            ("PARA", 2, r"^\s*\[(\d{1,4})\]\s+(.+)$"), ("PARA", 2, r"^\s*(\d{1,4})\.\s+(.+)$"),
        ],
        "de": [("SECT", 0, r"^\s*(Sachverhalt|Tatbestand|Entscheidungsgründe|Entscheidungsgruende|Gründe|Gruende|Tenor|Kosten)\s*$"), ("PARA", 2, r"^\s*\[(\d{1,4})\]\s+(.+)$"), ("PARA", 2, r"^\s*(\d{1,4})\.\s+(.+)$")],
        "es": [("SECT", 0, r"^\s*(Hechos|Antecedentes|Fundamentos|Considerandos|Fallo|Costas)\s*$"), ("PARA", 2, r"^\s*\[(\d{1,4})\]\s+(.+)$"), ("PARA", 2, r"^\s*(\d{1,4})\.\s+(.+)$")],
    },
    "contract": {
        "en": [
            ("SCHEDULE", 0, r"\b(?:Schedule|Exhibit|Appendix)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("PART", 1, r"\bPart\s+([IVXLCDM]+|\d+)\b"), ("CL", 2, r"\b(?:Clause|Cl\.?)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"),
            ("SEC", 2, r"\bSection\s+(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("ART", 2, r"\bArticle\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b"), ("SUBCL", 3, r"^\s*\(([a-z]|\d{1,3}[a-z]?|[ivxlcdm]+)\)\s+(.+)$"),
        ],
        "fr": [("SCHEDULE", 0, r"\b(?:Annexe|Pièce)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("PART", 1, r"\bPartie\s+([IVXLCDM]+|\d+)\b"), ("ART", 2, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + r")\b"), ("CL", 2, r"\bClause\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b")],
        "de": [("SCHEDULE", 0, r"\b(?:Anlage|Anhang)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("SEC", 2, r"\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("SUBCL", 3, r"^\s*\((\d{1,3}[a-z]?)\)\s+(.+)$")],
        "es": [("SCHEDULE", 0, r"\b(?:Anexo|Apéndice|Apendice)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("CL", 2, r"\b(?:Cláusula|Clausula)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"), ("ART", 2, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b")],
    },
    "unknown": {
        "en": [
            ("ART", 4, r"\b(?:Article|Art\.?)\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?" + RANGE + BIS + r")\b"), ("SEC", 3, r"\b(?:Section|Sec\.?|§)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("CL", 3, r"\b(?:Clause|Cl\.?)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"),
            ("PARA", 4, r"^\s*(\d{1,4}[A-Za-z]?)\.\s+(.+)$"), ("SUBPARA", 5, r"^\s*\((\d{1,3}[a-z]?|[a-z]|[ivxlcdm]+)\)\s+(.+)$"), ("CH", 1, r"\b(?:Chapter|Ch\.?)\s+([IVXLCDM]+|\d+)\b"), ("TITLE", 0, r"\b(?:Title|Tit\.?)\s+([IVXLCDM]+|\d+)\b"),
            ("PART", 0, r"\b(?:Part|Pt\.?)\s+([IVXLCDM]+|\d+)\b"), ("SCHEDULE", 0, r"\b(?:Schedule|Annex|Exhibit|Appendix)\s+([IVXLCDM]+|\d+|[A-Z])\b"),
        ],
        "fr": [
            ("ART", 4, r"\b(?:Article|Art\.?)\s+(\d{1,4}(?:er|ère|eme|ème)?" + RANGE + TER + r")\b"), ("SEC", 3, r"\bSection\s+(\d+[A-Za-z]?)\b"), ("TITLE", 0, r"\bTitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"),
            ("CH", 1, r"\bChapitre\s+([IVXLCDM]+|\d+)(?:er|ère|eme|ème)?\b"), ("PART", 0, r"\bPartie\s+([IVXLCDM]+|\d+)\b"), ("SCHEDULE", 0, r"\b(?:Annexe|Pièce)\s+([IVXLCDM]+|\d+|[A-Z])\b"),
        ],
        "de": [("ART", 4, r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b"), ("SEC", 3, r"\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("CH", 1, r"\b(?:Kapitel|Abschnitt)\s+([IVXLCDM]+|\d+)\b"), ("PART", 0, r"\bTeil\s+([IVXLCDM]+|\d+)\b")],
        "es": [("ART", 4, r"\b(?:Artículo|Articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b"), ("SEC", 3, r"\b(?:Sección|Seccion)\s+(\d+[A-Za-z]?)\b"), ("CH", 1, r"\b(?:Capítulo|Capitulo)\s+([IVXLCDM]+|\d+)\b")],
    },
}
ANNEXES = ("SCHEDULE", "ANNEX")

# Prose blocks of French judgments: (id, element, role, form with the marker as group 1).
FRENCH_BLOCKS = [
    ("ISSUES", "ISSUE", "issues", r"(?:^|\n)(Sur\s+(?:les?|la)\s+[^\n:]{2,180}(?:moyens?|branches?)[^\n:]*\s*:)"),
    ("CLAIMS", "CLAIMS", "claims", r"(?:^|\n)(Attendu\s+que\s+[^\n]*?fait\s+grief\s+[^\n]*?(?:alors,\s+selon\s+le\s+moyen\s*:|alors\s+que))"),
    ("REASONING-1", "REASONING", "reasoning", r"(?:^|\n)(Mais\s+attendu(?:,\s*d['’]abord,?|\s+que))"),
    ("REASONING-2", "REASONING", "reasoning", r"(?:^|\n)(Attendu,?\s+ensuite,?\s+que)"),
    ("CONCLUSION", "CONCLUSION", "holding", r"(?:^|\n)(D['’]où\s+il\s+suit\s+que)"),
    ("DISPOSITION", "DISPOSITION", "disposition", r"(?:^|\n)(PAR\s+CES\s+MOTIFS\b[^:\n]*\s*:)"),
    ("ORDER", "ORDER", "order", r"(?:^|\n)((?:REJETTE|CASSE(?:\s+ET\s+ANNULE)?|ANNULE|DIT\s+N['’]Y\s+AVOIR\s+LIEU)[^\n.]*(?:\.|$))"),
    ("SOURCE-ANALYSIS", "SOURCE_ANALYSIS", "source-analysis", r"(?:^|\n)(Analyse)\s*(?=\n|\Z)"),
]
# Labels of the roles of those blocks.
ROLE_LABELS = {"issues": "Grounds raised", "claims": "Applicant's claims", "reasoning": "Court reasoning", "holding": "Holding", "disposition": "Disposition", "order": "Operative order"}

# References that every type looks for: (form with the target as group 1, element, kind).
REFERENCES: dict[str, list[tuple[str, str, str]]] = {
    "en": [
        (r"\b(?:Article|Art\.?)\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?" + RANGE + BIS + r")\b", "ART", "article-reference"), (r"\b(?:Section|Sec\.?|§)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b", "SEC", "section-reference"),
        (r"\b(?:Chapter|Ch\.?)\s+([IVXLCDM]+|\d+)\b", "CH", "chapter-reference"), (r"\b(?:Title|Tit\.?)\s+([IVXLCDM]+|\d+)\b", "TITLE", "title-reference"), (r"\b(?:Part|Pt\.?)\s+([IVXLCDM]+|\d+)\b", "PART", "part-reference"),
        (r"\b(?:paragraph|paragraphs?|para\.?|¶)\s*(\d+[A-Za-z]?)\b", "PARA", "paragraph-reference"), (r"\b(?:clause|clauses?|cl\.?)\s+(\d+[A-Za-z]?)\b", "CL", "clause-reference"), (r"\b(?:schedule|schedules?|sch\.?)\s+([IVXLCDM]+|\d+)\b", "SCHEDULE", "schedule-reference"),
    ],
    "fr": [
        (r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?" + RANGE + BIS + r")\b", "ART", "article-reference"), (r"\btitre\s+([IVXLCDM]+|\d+)(?:er)?\b", "TITLE", "title-reference"), (r"\bchapitre\s+([IVXLCDM]+|\d+)(?:er)?\b", "CH", "chapter-reference"),
        (r"\bsection\s+(\d+[A-Za-z]?)\b", "SEC", "section-reference"), (r"\b(?:alinéa|alinea|alinéas|alineas)\s+(\d+[A-Za-z]?)\b", "PARA", "paragraph-reference"),
    ],
    "de": [
        (r"\b(?:Artikel|Art\.?)\s+(\d{1,4}[A-Za-z]?" + RANGE + r")\b", "ART", "article-reference"), (r"\bAbschnitt\s+([IVXLCDM]+|\d+)\b", "SEC", "section-reference"),
        (r"\b(?:Absatz|Abs\.?|Absätze|Absaetze)\s+(\d+[A-Za-z]?)\b", "PARA", "paragraph-reference"), (r"\bSatz\s+(\d+)\b", "SENTENCE", "sentence-reference"),
    ],
    "es": [
        (r"\b(?:artículo|articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?" + RANGE + r")\b", "ART", "article-reference"), (r"\b(?:título|titulo)\s+([IVXLCDM]+|\d+)\b", "TITLE", "title-reference"), (r"\b(?:capítulo|capitulo)\s+([IVXLCDM]+|\d+)\b", "CH", "chapter-reference"),
        (r"\b(?:sección|seccion)\s+(\d+[A-Za-z]?)\b", "SEC", "section-reference"), (r"\b(?:apartado|apartados?)\s+(\d+[A-Za-z]?)\b", "PARA", "paragraph-reference"),
    ],
}
# Further references of each type.
TYPE_REFERENCES: dict[str, dict[str, list[tuple[str, str, str]]]] = {
    "constitution": {"en": [(r"\b(?:pursuant\s+to|under|according\s+to|provided\s+in|referred\s+to\s+in)\s+Amendment\s+([IVXLCDM]+|\d+)\b", "AMEND", "amendment-reference")]},
    "regulation": {
        "en": [(r"\bRegulation\s+\(?(?:EU|EC|Euratom)\)?\s*(?:No\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bDirective\s+(\d{4}/\d{1,4}/?(?:EU|EC)?)\b", "DIR", "directive-reference"), (r"\bAnnex\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\brecital\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
        "fr": [(r"\b(?:règlement|reglement)\s+\(?(?:UE|CE|Euratom)\)?\s*(?:n°?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bdirective\s+(\d{4}/\d{1,4}/?(?:UE|CE)?)\b", "DIR", "directive-reference"), (r"\bannexe\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\b(?:considérant|considerant)\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
        "de": [(r"\bVerordnung\s+\(?(?:EU|EG|Euratom)\)?\s*(?:Nr\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bRichtlinie\s+(\d{4}/\d{1,4}/?(?:EU|EG)?)\b", "DIR", "directive-reference"), (r"\bAnhang\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\b(?:Erwägungsgrund|Erwaegungsgrund)\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
        "es": [(r"\bReglamento\s+\(?(?:UE|CE|Euratom)\)?\s*(?:n\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bDirectiva\s+(\d{4}/\d{1,4}/?(?:UE|CE)?)\b", "DIR", "directive-reference"), (r"\bAnexo\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\bconsiderando\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
    },
    "directive": {
        "en": [(r"\bDirective\s+\(?(?:EU|EC|EEC)?\)?\s*(?:No\.?\s*)?(\d{4}/\d{1,4}/?(?:EU|EC|EEC)?)\b", "DIR", "directive-reference"), (r"\bRegulation\s+\(?(?:EU|EC|Euratom)\)?\s*(?:No\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bAnnex\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\brecital\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
        "fr": [(r"\bdirective\s+\(?(?:UE|CE|CEE)?\)?\s*(?:n°?\s*)?(\d{4}/\d{1,4}/?(?:UE|CE|CEE)?)\b", "DIR", "directive-reference"), (r"\b(?:règlement|reglement)\s+\(?(?:UE|CE|Euratom)\)?\s*(?:n°?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bannexe\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference"), (r"\b(?:considérant|considerant)\s+\(?(\d{1,3})\)?\b", "RECITAL", "recital-reference")],
        "de": [(r"\bRichtlinie\s+\(?(?:EU|EG|EWG)?\)?\s*(?:Nr\.?\s*)?(\d{4}/\d{1,4}/?(?:EU|EG|EWG)?)\b", "DIR", "directive-reference"), (r"\bVerordnung\s+\(?(?:EU|EG|Euratom)\)?\s*(?:Nr\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bAnhang\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference")],
        "es": [(r"\bDirectiva\s+\(?(?:UE|CE|CEE)?\)?\s*(?:n\.?\s*)?(\d{4}/\d{1,4}/?(?:UE|CE|CEE)?)\b", "DIR", "directive-reference"), (r"\bReglamento\s+\(?(?:UE|CE|Euratom)\)?\s*(?:n\.?\s*)?(\d{1,4}/\d{1,4})\b", "REG", "regulation-reference"), (r"\bAnexo\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference")],
    },
    "treaty": {
        "en": [(r"\bProtocol\s+([IVXLCDM]+|\d+|[A-Z])\b", "PROTOCOL", "protocol-reference"), (r"\bAnnex\s+([IVXLCDM]+|\d+|[A-Z])\b", "ANNEX", "annex-reference"), (r"\b(?:Convention|Treaty|Agreement)\s+(?:of\s+)?(\d{4})\b", "TREATY", "treaty-reference")],
        "fr": [(r"\bProtocole\s+([IVXLCDM]+|\d+|[A-Z])\b", "PROTOCOL", "protocol-reference"), (r"\bAnnexe\s+([IVXLCDM]+|\d+|[A-Z])\b", "ANNEX", "annex-reference")],
    },
    "statute": {
        "en": [
            (r"\b(?:section|s\.|ss\.)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b", "SEC", "section-reference"), (r"\b(?:subsection|sub-s\.)\s*\(?(\d{1,3}[a-z]?)\)?\b", "SUBSEC", "subsection-reference"), (r"\b(?:schedule|Sch\.?)\s+([IVXLCDM]+|\d+|[A-Z])\b", "SCHEDULE", "schedule-reference"),
            (r"\b(?:part|Pt\.?)\s+([IVXLCDM]+|\d+)\b", "PART", "part-reference"), (r"\b(?:paragraph|para\.?)\s+\(?([ivxlcdm]+|\d+[A-Za-z]?)\)?\b", "PARA", "paragraph-reference"),
        ],
        "fr": [(r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?" + RANGE + r")\b", "ART", "article-reference"), (r"\bsection\s+(\d+[A-Za-z]?)\b", "SEC", "section-reference"), (r"\bannexe\s+([IVXLCDM]+|\d+)\b", "ANNEX", "annex-reference")],
        "de": [(r"\b(?:§|Paragraph|Abschnitt)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b", "SEC", "section-reference"), (r"\b(?:Absatz|Abs\.?)\s*\(?(\d{1,3}[a-z]?)\)?\b", "SUBSEC", "subsection-reference")],
        "es": [(r"\b(?:artículo|articulo|Art\.?)\s+(\d{1,4}[A-Za-z]?(?:°|º)?)\b", "ART", "article-reference")],
    },
    "judgment": {
        "en": [(r"\b(?:paragraph|para\.?)\s+\[?(\d{1,4})\]?\b", "PARA", "paragraph-reference"), (r"\bCase\s+(?:No\.?|C-)?(\d+/\d+\s*(?:P)?)\b", "CASE", "case-reference"), (r"\bArticle\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?)\b", "ART", "article-reference")],
        "fr": [(r"\b(?:point|paragraphe)\s+\[?(\d{1,4})\]?\b", "PARA", "paragraph-reference"), (r"\baffaire\s+(C-?\d+/\d+)\b", "CASE", "case-reference")],
    },
    "contract": {
        "en": [(r"\b(?:clause|Cl\.?)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b", "CL", "clause-reference"), (r"\b(?:section|s\.)\s+(\d+[A-Za-z]?(?:\.\d+)?)\b", "SEC", "section-reference"), (r"\b(?:schedule|Sch\.?|exhibit|appendix)\s+([IVXLCDM]+|\d+|[A-Z])\b", "SCHEDULE", "schedule-reference"), (r"\b(?:article|Art\.?)\s+(\d{1,4})\b", "ART", "article-reference")],
        "fr": [(r"\bclause\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b", "CL", "clause-reference"), (r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?)\b", "ART", "article-reference")],
        "de": [(r"\b(?:§|Paragraph)\s*(\d+[A-Za-z]?)\b", "SEC", "section-reference")],
        "es": [(r"\b(?:cláusula|clausula)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b", "CL", "clause-reference")],
    },
    "unknown": {},
}
# Elements whose text is searched for references, and whether a text that holds deeper elements is left to those.
REFERENCE_SOURCES: dict[str, tuple[tuple[str, ...] | None, bool]] = {
    "constitution": (("ART", "SEC", "CL"), True), "regulation": (("RECITALS", "ART", "PARA", "SEC", "ANNEX"), True), "directive": (("RECITALS", "ART", "PARA", "SEC", "ANNEX"), True),
    "treaty": (("TREATY_PREAMBLE", "ART", "SEC", "PROTOCOL", "ANNEX", "CLOSING"), True), "statute": (("ENACTMENT", "SEC", "ART", "SUBSEC", "PARA", "SCHEDULE", "ANNEX"), True),
    "judgment": (("HEADER", "SECT", "PARA", "SUBPARA"), False), "contract": (("RECITALS", "CL", "SEC", "ART", "SUBCL", "SCHEDULE", "SIGNATURES"), True), "unknown": (None, False),
}
# Elements that are a type's core units, the least number without a warning, and its code.
CORE_UNITS = {
    "constitution": (("ART",), 3, "LOW_ARTICLE_COUNT"), "regulation": (("ART",), 3, "LOW_ARTICLE_COUNT"), "directive": (("ART",), 3, "LOW_ARTICLE_COUNT"), "treaty": (("ART",), 2, "LOW_ARTICLE_COUNT"),
    "statute": (("SEC", "ART"), 2, "LOW_CORE_UNIT_COUNT"), "judgment": (("PARA",), 2, "LOW_PARAGRAPH_COUNT"), "contract": (("CL", "SEC", "ART"), 2, "LOW_CLAUSE_COUNT"), "unknown": (None, 0, ""),
}

# Markers of blocks by type and language.
ENACTING = {
    "regulation": {"en": r"\b(?:HAVE|HAS)\s+ADOPTED\s+THIS\s+REGULATION\s*:", "fr": r"\b(?:ONT|A)\s+ADOPTÉ\s+LE\s+PRÉSENT\s+RÈGLEMENT\s*:", "de": r"\b(?:HABEN|HAT)\s+FOLGENDE\s+VERORDNUNG\s+ERLASSEN\s*:", "es": r"\b(?:HAN|HA)\s+ADOPTADO\s+EL\s+PRESENTE\s+REGLAMENTO\s*:"},
    "directive": {"en": r"\b(?:HAVE|HAS)\s+ADOPTED\s+THIS\s+DIRECTIVE\s*:", "fr": r"\b(?:ONT|A)\s+ADOPTÉ\s+LA\s+PRÉSENTE\s+DIRECTIVE\s*:", "de": r"\b(?:HABEN|HAT)\s+FOLGENDE\s+RICHTLINIE\s+ERLASSEN\s*:", "es": r"\b(?:HAN|HA)\s+ADOPTADO\s+LA\s+PRESENTE\s+DIRECTIVA\s*:"},
}
RECITAL_STARTS = {
    "en": r"\b(?:Whereas|Having\s+regard\s+to|After\s+consulting|Acting\s+in\s+accordance\s+with)\b", "fr": r"\b(?:considérant|vu\s+le|après\s+consultation|statuant\s+conformément)\b",
    "de": r"\b(?:in\s+Erwägung|gestützt\s+auf|nach\s+Stellungnahme)\b", "es": r"\b(?:considerando|visto\s+el|previa\s+consulta)\b",
}
CONTRACT_RECITALS = {"en": r"\b(?:WHEREAS|WITNESSETH|NOW\s*,?\s+THEREFORE)\b", "fr": r"\b(?:ATTENDU\s+QUE|EXPOSÉ\s+PRÉALABLE|EXPOSE\s+PREALABLE|IL\s+A\s+ÉTÉ\s+CONVENU)\b", "de": r"\b(?:IN\s+ERWÄGUNG|IN\s+ERWAEGUNG|WIRD\s+FOLGENDES\s+VEREINBART)\b", "es": r"\b(?:CONSIDERANDO|EXPONEN|ACUERDAN)\b"}
OPERATIVE = {"en": r"\b(?:NOW\s*,?\s+THEREFORE|The\s+parties\s+agree\s+as\s+follows)\b", "fr": r"\b(?:IL\s+A\s+ÉTÉ\s+CONVENU|Les\s+parties\s+conviennent)\b", "de": r"\b(?:wird\s+Folgendes\s+vereinbart)\b", "es": r"\b(?:ACUERDAN|Las\s+partes\s+acuerdan)\b"}
SIGNATURES = {
    "en": r"\b(?:IN\s+WITNESS\s+WHEREOF|SIGNED\s+(?:by|for\s+and\s+on\s+behalf\s+of)|EXECUTED\s+(?:as\s+a\s+deed|on\s+the\s+date))\b", "fr": r"\b(?:FAIT\s+À|FAIT\s+A|SIGNÉ|SIGNE|EN\s+FOI\s+DE\s+QUOI)\b",
    "de": r"\b(?:UNTERSCHRIFT|UNTERZEICHNET|ORT,\s+DATUM)\b", "es": r"\b(?:FIRMADO|FIRMA|EN\s+FE\s+DE\s+LO\s+CUAL|HECHO\s+EN)\b",
}
TREATY_STARTS = {
    "en": r"\b(?:The\s+(?:High\s+)?Contracting\s+Parties|The\s+Parties\s+to\s+this|Desiring\s+to|Recognizing\s+that|Considering\s+that)\b", "fr": r"\b(?:Les\s+(?:Hautes\s+)?Parties\s+contractantes|Désireuses\s+de|Reconnaissant\s+que|Considérant\s+que)\b",
    "de": r"\b(?:Die\s+Vertrags(?:parteien|staaten)|in\s+dem\s+Wunsch|in\s+der\s+Erkenntnis)\b", "es": r"\b(?:Las\s+(?:Altas\s+)?Partes\s+Contratantes|Deseando|Reconociendo|Considerando)\b",
}
AGREED = {"en": r"\b(?:Have\s+agreed\s+as\s+follows|Agree\s+as\s+follows)\s*:", "fr": r"\b(?:Sont\s+convenu(?:e)?s?\s+de\s+ce\s+qui\s+suit)\s*:", "de": r"\b(?:sind\s+wie\s+folgt\s+übereingekommen)\s*:", "es": r"\b(?:Han\s+convenido\s+lo\s+siguiente)\s*:"}
CLOSING = {"en": r"\b(?:IN\s+WITNESS\s+WHEREOF|Done\s+at)\b", "fr": r"\b(?:EN\s+FOI\s+DE\s+QUOI|Fait\s+à)\b", "de": r"\b(?:ZU\s+URKUND\s+DESSEN|Geschehen\s+zu)\b", "es": r"\b(?:EN\s+FE\s+DE\s+LO\s+CUAL|Hecho\s+en)\b"}
ENACTMENT = {
    "en": [r"\bBe\s+it\s+enacted\s+by\b", r"\bENACTED\s+by\b"], "fr": [r"\bEst\s+promulguée\b", r"\bL'?Assemblée\s+nationale\s+a\s+adopté\b"],
    "de": [r"\bhat\s+(?:der\s+)?Bundestag\s+(?:das\s+)?folgende\s+Gesetz\s+beschlossen\b", r"\bverkündet\b"], "es": [r"\bLas\s+Cortes\s+Generales\s+han\s+aprobado\b", r"\bse\s+promulga\b"],
}
CASE_HEADERS = {
    "en": [r"\b(?:JUDGMENT|JUDGEMENT|ORDER|DECISION|RULING|OPINION)\s+(?:OF\s+)?(?:THE\s+)?(?:COURT|TRIBUNAL|CHAMBER)\b", r"\b(?:v\.|vs\.|versus)\b"],
    "fr": [r"\b(?:ARRÊT|ARRET|JUGEMENT|ORDONNANCE|DÉCISION|DECISION)\s+(?:DE\s+LA\s+)?(?:COUR|TRIBUNAL|CHAMBRE)\b", r"\bCour\s+de\s+cassation\s*[-,]\s*(?:Assembl[ée]e\s+pl[ée]ni[èe]re|Chambre\s+mixte|[^\n,]{2,80}chambre)\b", r"\b(?:c\.|c/|contre)\b"],
    "de": [r"\b(?:URTEIL|BESCHLUSS|ENTSCHEIDUNG)\s+(?:DES|DER)\s+(?:GERICHTS|GERICHTSHOFS|KAMMER)\b", r"\b(?:gegen|g\.|\./\.)\b"], "es": [r"\b(?:SENTENCIA|AUTO|DECISIÓN|DECISION)\s+(?:DEL|DE\s+LA)\s+(?:TRIBUNAL|CORTE|SALA)\b", r"\b(?:c\.|c/|contra)\b"],
}
HEADER_END = r"\b(?:Facts|Background|Procedural\s+History|The\s+facts|Introduction|Faits(?:\s+et\s+proc[ée]dure)?|Expos[ée]\s+du\s+litige|Rappel\s+des\s+faits|Motifs(?:\s+de\s+la\s+d[ée]cision)?|Sur\s+ce|Par\s+ces\s+motifs|Hechos|Sachverhalt)\b"
DISPOSITIONS = {
    "en": r"\b(?:For\s+these\s+reasons|The\s+Court\s+(?:orders|holds|declares)|It\s+is\s+ordered|appeal\s+is\s+(?:allowed|dismissed)|claim\s+is\s+(?:allowed|dismissed))\b", "fr": r"\b(?:Par\s+ces\s+motifs|La\s+Cour\s+(?:déclare|ordonne)|rejette|annule)\b",
    "de": r"\b(?:Aus\s+diesen\s+Gründen|Tenor|Die\s+Klage\s+wird)\b", "es": r"\b(?:Por\s+estos\s+motivos|Fallo|El\s+Tribunal\s+(?:declara|ordena))\b",
}
OPINIONS = {
    "en": [(r"\bdissenting\s+opinion\b", "dissenting"), (r"\bconcurring\s+opinion\b", "concurring"), (r"\bseparate\s+opinion\b", "separate"), (r"\bopinion\s+of\s+(?:Judge|Justice|Advocate\s+General)\b", "other")],
    "fr": [(r"\bopinion\s+dissidente\b", "dissenting"), (r"\bopinion\s+concordante\b", "concurring"), (r"\b(?:opinion\s+séparée|opinion\s+separee|conclusions\s+de\s+l'?Avocat\s+Général)\b", "other")],
}
# Where the body of a document starts (letter case counts, but for contracts), and the position if nothing says so.
BODY_STARTS = {
    "regulation": (r"\b(?:CHAPTER|Chapter|Article|ARTICLE|ANNEX|Annex)\s+([IVXLCDM]+|\d+)", 5000), "directive": (r"\b(?:CHAPTER|Chapter|Article|ARTICLE|ANNEX|Annex)\s+([IVXLCDM]+|\d+)", 6000),
    "treaty": (r"\b(?:Article|ARTICLE|Artículo|Artikel)\s+([IVXLCDM]+|\d+)", 4000), "statute": (r"\b(?:Part|PART|Section|SECTION|Schedule|SCHEDULE|Article|ARTICLE)\s+([IVXLCDM]+|\d+)", 1500), "contract": (r"(?i)\b(?:Clause|Section|Article)\s+\d+", 4000),
}
PREAMBLE_WORDS = {
    "en": ["preamble", "we the people", "in the name of", "ordain and establish", "do ordain", "hereby adopt", "have adopted", "establish this constitution", "recognizing", "affirming", "proclaim", "declare", "solemnly", "fundamental rights", "human dignity"],
    "fr": ["préambule", "preambule", "au nom du", "proclame", "déclare", "le peuple", "la nation", "adopté", "solennellement", "droits de l'homme", "libertés fondamentales", "dignité humaine"],
    "de": ["präambel", "praambel", "im namen", "verabschiedet", "verkündet", "das volk", "die nation", "grundgesetz", "verfassung", "menschenwürde", "grundrechte"],
    "es": ["preámbulo", "preambulo", "en el nombre", "proclama", "declara", "el pueblo", "la nación", "adoptado", "solemnemente", "derechos fundamentales", "dignidad humana"],
}
AMENDMENT_WORDS = {
    "en": ["amendment", "amended by", "constitutional law", "constitutional amendment", "revised by", "modification", "revision"],
    "fr": ["amendement", "modification", "révision", "loi constitutionnelle", "modifié par", "révisé par", "abrogé"],
    "de": ["änderung", "änderungsgesetz", "verfassungsänderung", "geändert", "novelle", "revision", "aufgehoben"],
    "es": ["enmienda", "modificación", "revisión", "reforma constitucional", "modificado por", "derogado"],
}
TRANSPOSITION = {
    "en": [r"\btranspos(?:e|ed|ing|ition)\b", r"\badopt\s+and\s+publish\b", r"\bMember\s+States\s+shall\s+(bring\s+into\s+force|communicate|apply)\b"],
    "fr": [r"\btranspos(?:er|ition|é|ée|és|ées)\b", r"\badoptent\s+et\s+publient\b", r"\bÉtats\s+membres\s+(mettent\s+en\s+vigueur|communiquent|appliquent)\b"],
    "de": [r"\b(?:umsetzen|Umsetzung|umgesetzt)\b", r"\bMitgliedstaaten\s+(setzen|erlassen|übermitteln|wenden)\b"],
    "es": [r"\b(?:transponer|transposición|transpuesto)\b", r"\bEstados\s+miembros\s+(adoptarán|comunicarán|aplicarán)\b"],
}
STATUTE_AMENDS = r"\b(amend|repeal|substituted|inserted|omitted|modif|abrog)\b"
COMMENCEMENT = r"\b(commencement|coming\s+into\s+force|comes\s+into\s+force|enters\s+into\s+force)\b"
BOILERPLATE = {
    "governing-law": {"en": [r"\bgoverning\s+law\b", r"\bjurisdiction\b"], "fr": [r"\bdroit\s+applicable\b", r"\bjuridiction\s+compétente\b"], "de": [r"\banwendbares\s+Recht\b", r"\bGerichtsstand\b"], "es": [r"\bley\s+aplicable\b", r"\bjurisdicción\b"]},
    "force-majeure": {"en": [r"\bforce\s+majeure\b", r"\bAct\s+of\s+God\b"], "fr": [r"\bforce\s+majeure\b", r"\bcas\s+fortuit\b"], "de": [r"\bhöhere\s+Gewalt\b"], "es": [r"\bfuerza\s+mayor\b"]},
    "confidentiality": {"en": [r"\bconfidential(?:ity)?\b", r"\bnon-disclosure\b"], "fr": [r"\bconfidentialité\b", r"\bnon-divulgation\b"], "de": [r"\bVertraulichkeit\b", r"\bGeheimhaltung\b"], "es": [r"\bconfidencialidad\b"]},
    "termination": {"en": [r"\btermination\b", r"\bterm\s+and\s+termination\b"], "fr": [r"\brésiliation\b"], "de": [r"\bKündigung\b"], "es": [r"\bterminación\b"]},
    "indemnification": {"en": [r"\bindemnif(?:y|ication)\b", r"\bhold\s+harmless\b"], "fr": [r"\bindemnisation\b"], "de": [r"\bFreistellung\b"], "es": [r"\bindemnización\b"]},
    "entire-agreement": {"en": [r"\bentire\s+agreement\b", r"\bwhole\s+agreement\b"], "fr": [r"\bintégralité\s+de\s+l'?accord\b"], "de": [r"\bgesamte\s+Vereinbarung\b"], "es": [r"\bintegridad\s+del\s+acuerdo\b"]},
    "severability": {"en": [r"\bseverability\b", r"\bseverable\b"], "fr": [r"\bdivisibilité\b", r"\bnullité\s+partielle\b"], "de": [r"\bSalvatorische\s+Klausel\b"], "es": [r"\bdivisibilidad\b"]},
    "dispute-resolution": {"en": [r"\bdispute\s+resolution\b", r"\barbitration\b", r"\bmediation\b"], "fr": [r"\brèglement\s+des\s+différends\b", r"\barbitrage\b"], "de": [r"\bStreitbeilegung\b", r"\bSchiedsverfahren\b"], "es": [r"\bresolución\s+de\s+conflictos\b", r"\barbitraje\b"]},
}
# Citations in judgments: (form, kind, whether letter case counts).
CITATIONS = [
    (r"\bC(?:ase|ASE)\s+(?:No\.?\s*)?(C-?\d+/\d+(?:\s*P)?)\b", "case-citation", True), (r"\b\[\d{4}\]\s+(?:UKSC|UKHL|UKPC|EWCA|EWHC|USSC|SCC)\s+\d+\b", "neutral-citation", True), (r"\b\d+\s+(?:U\.S\.|F\.?\s?Supp\.?|F\.?\s?\d+d|S\.Ct\.)\s+\d+\b", "reporter-citation", True),
    (r"\b(?:Regulation|Directive)\s+\(?(?:EU|EC|EEC)?\)?\s*(?:No\.?\s*)?\d{4}/\d{1,4}/?(?:EU|EC|EEC)?\b", "eu-law-citation", False), (r"\b(?:Article|ARTICLE|Art\.?)\s+\d{1,4}[A-Za-z]?\b", "legal-provision-citation", True),
]

# Months, and forms of dates.
DATE_EN = r"\b\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b"
DATE_FR = r"\b\d{1,2}\s+(?:janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)\s+\d{4}\b"
DATE_FR_LOOSE = r"\b\d{1,2}\s+(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre)\s+\d{4}\b"
DATE_ISO = r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b"
DATE_DMY = r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"
EU_BODY = r"\b(European\s+Parliament\s+and\s+(?:of\s+)?the\s+Council|Council\s+of\s+the\s+European\s+Union|European\s+Commission)\b"
# Metadata fields: (field, lines of the head or 0 for the whole text, forms of which the first that fits counts, template);
# {0} is the match and {1} its group, a bare word a fixed value.
FIELDS: dict[str, list[tuple[str, int, list[str], str]]] = {
    "constitution": [
        ("jurisdiction", 20, [r"\b(France|République\s+française|French)\b"], "France"), ("jurisdiction", 20, [r"\b(United\s+States|United\s+States\s+of\s+America|America)\b"], "United States"), ("jurisdiction", 20, [r"\b(Germany|Deutschland|Bundesrepublik\s+Deutschland)\b"], "Germany"),
        ("jurisdiction", 20, [r"\b(Spain|España|Reino\s+de\s+España)\b"], "Spain"), ("jurisdiction", 20, [r"\b(India|Republic\s+of\s+India|Bharat)\b"], "India"), ("jurisdiction", 20, [r"\b(Canada|Canadian)\b"], "Canada"), ("jurisdiction", 20, [r"\b(Australia|Commonwealth\s+of\s+Australia)\b"], "Australia"),
        ("adoption_date", 20, [DATE_EN, DATE_FR, DATE_ISO, DATE_DMY], "{0}"),
    ],
    "regulation": [
        ("regulation_number", 35, [r"\bRegulation\s+\(EU\)\s+(?:No\.?\s*)?(\d{4}/\d{1,4})\b", r"\bRèglement\s+\(UE\)\s+(?:n°?\s*)?(\d{4}/\d{1,4})\b"], "Regulation (EU) {1}"), ("jurisdiction", 35, [r"European\s+Union|\(EU\)|\bEU\b"], "European Union"),
        ("adoption_date", 35, [DATE_EN, DATE_FR, DATE_ISO, DATE_DMY], "{0}"), ("adopting_body", 35, [EU_BODY], "{1}"),
    ],
    "directive": [
        ("directive_number", 35, [r"\bDirective\s+\(?(?:EU|EC|EEC)?\)?\s*(?:No\.?\s*)?(\d{4}/\d{1,4}/?(?:EU|EC|EEC)?)\b"], "Directive {1}"), ("jurisdiction", 35, [r"European\s+Union|\(EU\)|\bEU\b"], "European Union"), ("adoption_date", 35, [DATE_EN], "{0}"), ("adopting_body", 35, [EU_BODY], "{1}"),
    ],
    "treaty": [("jurisdiction", 0, [r"(?s)^"], "International"), ("depositary", 0, [r"\bdepositary\s+(?:shall\s+be|is)\s+([^.\n]+)"], "{1}")],
    "statute": [
        ("short_title", 0, [r"\bThis\s+Act\s+may\s+be\s+cited\s+as\s+(?:the\s+)?(.+?)(?:\.|\n)"], "{1}"), ("act_number", 35, [r"\b(?:Act\s+No\.?\s*\d+\s+of\s+\d{4}|Public\s+Law\s+\d{2,3}[-–]\d{1,4})\b"], "{0}"),
        ("jurisdiction", 35, [r"\b(?:United\s+Kingdom|UK|Parliament\s+of\s+the\s+United\s+Kingdom)\b"], "United Kingdom"), ("jurisdiction", 35, [r"\b(?:United\s+States|Congress|USC|U\.S\.C\.|Public\s+Law)\b"], "United States"), ("jurisdiction", 35, [r"\b(?:Canada|Parliament\s+of\s+Canada)\b"], "Canada"),
        ("jurisdiction", 35, [r"\b(?:Australia|Commonwealth\s+of\s+Australia)\b"], "Australia"), ("jurisdiction", 35, [r"\b(?:France|République\s+française|Assemblée\s+nationale|Sénat)\b"], "France"), ("jurisdiction", 35, [r"\b(?:Germany|Deutschland|Bundestag|Bundesrepublik)\b"], "Germany"),
        ("adoption_date", 35, [DATE_EN, DATE_ISO], "{0}"),
    ],
    "judgment": [
        ("court", 45, [
            r"\bJUDGMENT\s+OF\s+THE\s+(COURT|TRIBUNAL|CHAMBER)\b",
            r"\b(Court\s+of\s+(?:Justice|Appeal|First\s+Instance|Cassation)|Supreme\s+Court|Constitutional\s+Court|High\s+Court|District\s+Court|European\s+Court\s+of\s+(?:Justice|Human\s+Rights)|International\s+Court\s+of\s+Justice|Arbitral\s+Tribunal)\b",
            r"\b(Cour\s+(?:de\s+(?:justice|cassation)|d'appel|administrative\s+d'appel|européenne)|Conseil\s+d['’]État|Conseil\s+d['’]Etat|Conseil\s+constitutionnel|Tribunal\s+(?:judiciaire|administratif|de\s+commerce|correctionnel))\b",
            r"\b(Bundesgerichtshof|Bundesverfassungsgericht|Oberlandesgericht|Landgericht|Amtsgericht)\b", r"\b(Tribunal\s+(?:Supremo|Constitucional|de\s+Justicia)|Corte\s+(?:Suprema|Constitucional))\b"], "{0}"),
        ("judgment_date", 45, [DATE_EN, DATE_FR_LOOSE, DATE_ISO], "{0}"),
    ],
    "contract": [
        ("contract_type", 35, [r"\b(Master\s+Services?\s+Agreement|Service\s+Level\s+Agreement|Non-Disclosure\s+Agreement|Employment\s+Agreement|Lease\s+Agreement|Purchase\s+Agreement|License\s+Agreement|Distribution\s+Agreement|Partnership\s+Agreement|Agreement|Contract)\b"], "{1}"),
        ("agreement_date", 35, [r"\b(?:dated|made|entered\s+into)\s+(?:as\s+of\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4})\b"], "{1}"), ("agreement_date", 35, [DATE_EN], "{0}"),
    ],
    "unknown": [],
}
# Fields of French judgments, as FIELDS.
FRENCH_FIELDS = [
    ("formation", 45, [r"\b(Assembl[ée]e\s+pl[ée]ni[èe]re|Chambre\s+mixte|Premi[èe]re\s+chambre\s+civile|Deuxi[èe]me\s+chambre\s+civile|Troisi[èe]me\s+chambre\s+civile|Chambre\s+commerciale|Chambre\s+sociale|Chambre\s+criminelle)\b"], "sentence"),
    ("publication_status", 45, [r"\b(Publi[ée]\s+au\s+bulletin|Non\s+publi[ée]\s+au\s+bulletin|In[ée]dit)\b"], "sentence"), ("reporter_citation", 0, [r"(?:^|\n)(Bulletin\s+\d{4}[^\n]+)"], "{1}"),
    ("outcome", 0, [r"(?:^|\n)Solution\s*:\s*([^\n.]+)\.?", r"(?:^|\n)\s*(REJETTE|CASSE(?:\s+ET\s+ANNULE)?|ANNULE)\b"], "sentence"),
    ("lower_court", 45, [r"D[ée]cision\s+attaqu[ée]e\s*:\s*([^,\n]+),\s*\d{4}-\d{2}-\d{2}"], "{1}"), ("lower_court_date", 45, [r"D[ée]cision\s+attaqu[ée]e\s*:\s*[^,\n]+,\s*\d{4}-\d{2}-\d{2},\s*du\s*([^\n]+)", r"D[ée]cision\s+attaqu[ée]e\s*:\s*[^,\n]+,\s*(\d{4}-\d{2}-\d{2})"], "{1}"),
]
CASE_NUMBERS = [
    r"\bCase\s+(?:No\.?\s*)?(C-?\d+/\d+(?:\s*P)?)\b", r"\b\[?\d{4}\]?\s+(?:UKSC|UKHL|UKPC|EWCA|EWHC)\s+\d+\b",
    r"\b(?:N[°º]?\s*RG|RG\s*n[°º]?|N[°º]?\s*Portalis|R[ée]pertoire\s+g[ée]n[ée]ral|Minute\s+n[°º]?|Dossier\s+n[°º]?)\s*[:\-]?\s*[A-Z0-9/\-. ]{4,}\b", r"\bN[°º]\s+de\s+pourvoi\s*:\s*([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b",
    r"\b(?:pourvoi\s+)?n[°º]\s*([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b", r"\b([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b", r"\bDTA\s*\d{4,}\s*\d{8}\b", r"\b(?:No\.?|Nr\.?|n°)\s*\d[\d/\-.]+\b",
]
# Lines that may be the title: (lines of the head, least and most characters, share of capitals above which a line is a title,
# words that make it one, lines that are none, whether a line all in capitals is one).
TITLES: dict[str, tuple[int, int, int, float | None, str | None, str | None, bool]] = {
    "constitution": (20, 10, 220, 0.45, r"constitution|grundgesetz|constitución", r"^(Article|Section|Part|Chapter|Title|Titre|Chapitre|Artículo|Artikel)\b|\b(?:we\s+the\s+people|in\s+order\s+to|more\s+perfect\s+union|establish\s+justice|domestic\s+tranquility|common\s+defence|general\s+welfare|blessings\s+of\s+liberty|do\s+ordain|establish\s+this\s+constitution)\b", False),
    "regulation": (35, 15, 260, 0.55, r"\bRegulation\s+\(EU\)", None, False), "directive": (35, 15, 260, 0.55, r"\bDirective\b", None, False), "treaty": (30, 12, 240, None, r"\b(Treaty|Convention|Agreement|Protocol|Charter)\b", None, True),
    "statute": (35, 10, 220, None, r"\b(Act|Statute|Law|Code|Bill)\b", None, True), "contract": (35, 10, 220, None, r"\b(Agreement|Contract|Deed|Terms|Services|License|Lease|Purchase|Employment)\b", r"^(BETWEEN|WHEREAS|CLAUSE|SECTION|ARTICLE)\b", True),
    "unknown": (25, 10, 250, 0.4, None, r"^(Article|Section|Clause|Chapter|Part|Title)\b", False),
}
UNTITLED = {"constitution": "Untitled Constitution", "regulation": "Untitled Regulation", "directive": "Untitled Directive", "treaty": "Untitled Treaty", "statute": "Untitled Statute", "judgment": "Untitled Judgment", "contract": "Untitled Agreement", "unknown": "Untitled Legal Document"}
# Parties of contracts and judgments.
CONTRACT_PARTIES = {
    "en": [r"\bbetween\s+(.+?)\s+and\s+(.+?)(?:\s+and\s+(.+?))?\s*(?:\.|\n|$)", r"\bThis\s+Agreement\s+is\s+(?:made|entered\s+into).+?\s+between\s+(.+?)\s+(?:and|,)\s+(.+?)(?:\.|\n|$)"],
    "fr": [r"\bentre\s+(.+?)\s+et\s+(.+?)(?:\.|\n|$)"], "de": [r"\bzwischen\s+(.+?)\s+und\s+(.+?)(?:\.|\n|$)"], "es": [r"\bentre\s+(.+?)\s+y\s+(.+?)(?:\.|\n|$)"],
}
# The first form finds a separator with the name after it, the second both names.
JUDGMENT_PARTIES = {
    "en": (r"\s(?:v\.?|vs\.?|versus)\s+[A-Z][A-Za-z0-9\s,.&'-]+?\b(?:\n|\Z)", r"\b([A-Z][A-Za-z0-9\s,.&'-]+?)\s+(?:v\.?|vs\.?|versus)\s+([A-Z][A-Za-z0-9\s,.&'-]+?)\b(?:\n|\Z)"),
    "fr": (r"\s(?:c\.?|c/|contre)\s+[A-Z][A-Za-z0-9\s,.&'-]+?\b(?:\n|\Z)", r"\b([A-Z][A-Za-z0-9\s,.&'-]+?)\s+(?:c\.?|c/|contre)\s+([A-Z][A-Za-z0-9\s,.&'-]+?)\b(?:\n|\Z)"),
}
PARTY_LINES = (r"\b(?:Applicant|Appellant|Claimant|Plaintiff|Petitioner)\s*:\s*(.+?)(?:\n|\Z)", r"\b(?:Respondent|Defendant|Appellee)\s*:\s*(.+?)(?:\n|\Z)")
# Constitutions known by their text: title, short title, jurisdiction, authority, adoption date, date of force, reference.
US_CONSTITUTION = ("Constitution of the United States", "U.S. Constitution", "United States", "Constituent authority", "17 September 1787", "21 June 1788", "US-CONST")
FR_CONSTITUTION = ("Constitution du 4 octobre 1958", "Constitution française", "France", "Constituent authority", "4 octobre 1958", None, "FR-CONST-1958")
# Authorities in French judgments.
AUTHORITIES = [
    ("constitutional-provision", r"\barticle\s+77\s+de\s+la\s+Constitution\b"), ("constitutional-agreement", r"\baccord\s+de\s+Noum[ée]a\b"), ("statutory-provision", r"\barticle\s+188\s+de\s+la\s+loi\s+organique(?:\s+n[°º]\s*99-209)?\s+du\s+19\s+mars\s+1999\b"),
    ("treaty", r"\bPacte\s+international\s+relatif\s+aux\s+droits\s+civils\s+et\s+politiques\b"), ("treaty", r"\bConvention\s+europ[ée]enne\s+de\s+sauvegarde\s+des\s+droits\s+de\s+l['’]homme\s+et\s+des\s+libert[ée]s\s+fondamentales\b"), ("eu-treaty", r"\btrait[ée]\s+de\s+l['’]Union\s+europ[ée]enne\b"),
]
