"""SQL of the queries over parsed documents, written from the rules of each type and not from the engine's tables."""

from __future__ import annotations

from functools import reduce


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(c: str, *rules: tuple[str, str]) -> str:
    return reduce(lambda x, r: f"regexp_replace({x}, {quoted(r[0])}, {quoted(r[1])}, 'g')", rules, c)


def tidied(c: str) -> str:
    return replaced(c, ("\r\n?", "\n"), (" ", " "), ("[​-‍﻿]", ""), (r"[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), ("^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$", ""))


_TYPES = "('constitution', 'regulation', 'directive', 'treaty', 'statute', 'judgment', 'contract')"


def _docs(kind: str) -> str:
    return f"""docs as (select * from (select doc_id, {tidied("text")} as t, case when lang in ('fr', 'de', 'es') then lang else 'en' end as lang,
      case when document_type in {_TYPES} then document_type else 'unknown' end as kind from documents where text is not null) where kind = '{kind}' and length(t) >= {20 if kind == "unknown" else 50})"""


# Identifiers: Roman or Arabic; with a letter; with a decimal; articles with ranges and Latin suffixes.
_R, _RL, _D, _DD = r"[IVXLCDM]+|\d+", r"[IVXLCDM]+|\d+|[A-Z]", r"\d+[A-Za-z]?", r"\d+[A-Za-z]?(?:\.\d+)?"
_TO, _LATIN, _SHORT = r"(?:[-–—](?:\d{1,4}|[A-Za-z]+))?", r"(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies))?", r"(?:\s*(?:bis|ter|quater))?"
_EN, _FR, _ES, _C = r"\d{1,4}[A-Za-z]?" + _TO, r"\d{1,4}(?:er|ère|eme|ème)?" + _TO, r"\d{1,4}[A-Za-z]?[°º]?" + _TO, r"\d{1,4}[A-Za-z]?(?:\.\d+)?"
_TH = "(?:er|ère|eme|ème)?"


def _eu(latin: str) -> list[tuple]:
    return [
        ("en", "CH", 0, "Chapter", _R), ("en", "SEC", 1, "Section", _D), ("en", "ART", 2, "Article", _EN + latin), ("en", "ANNEX", 0, "Annex", _R),
        ("fr", "CH", 0, "Chapitre", _R, _TH), ("fr", "SEC", 1, "Section", _D), ("fr", "ART", 2, r"Article|Art\.?", _FR + latin), ("fr", "ANNEX", 0, "Annexe", _R),
        ("de", "CH", 0, "Kapitel", _R), ("de", "SEC", 1, "Abschnitt", _D), ("de", "ART", 2, r"Artikel|Art\.?", _EN), ("de", "ANNEX", 0, "Anhang", _R),
        ("es", "CH", 0, "Cap[ií]tulo", _R), ("es", "SEC", 1, "Secci[oó]n", _D), ("es", "ART", 2, r"Art[ií]culo|Art\.?", _ES), ("es", "ANNEX", 0, "Anexo", _R),
    ]


# (language, element, level, words, identifier, ending) for a word with an identifier, (language, element, level, whole form) for a form of a line.
_ROWS: dict[str, list[tuple]] = {
    "constitution": [
        ("en", "PREAMBLE", -1, r"(?i)^.{0,8}?\b(Preamble)\b"), ("en", "PART", 0, "Part", _R), ("en", "SCHEDULE", 0, "Schedule", _R), ("en", "AMEND", 0, "Amendment", _R), ("en", "TITLE", 1, "Title", _R), ("en", "CH", 2, "Chapter", _R), ("en", "SEC", 3, "Section", _D), ("en", "ART", 4, "Article", r"[IVXLCDM]+|" + _EN + _LATIN), ("en", "CL", 5, "Clause", _D),
        ("fr", "PREAMBLE", -1, r"(?i)^.{0,8}?\b(Pr[ée]ambule)\b"), ("fr", "PART", 0, "Partie", _R), ("fr", "TITLE", 1, "Titre", _R, _TH), ("fr", "CH", 2, "Chapitre", _R, _TH), ("fr", "SEC", 3, "Section", _D), ("fr", "ART", 4, r"Article|Art\.?", _FR + _LATIN),
        ("de", "PREAMBLE", -1, r"(?i)^.{0,8}?\b(Pr[äa]ambel)\b"), ("de", "TITLE", 1, "Titel", _R), ("de", "CH", 2, "Kapitel", _R), ("de", "SEC", 3, "Abschnitt", _R), ("de", "ART", 4, r"Artikel|Art\.?", _EN),
        ("es", "PREAMBLE", -1, r"(?i)^.{0,8}?\b(Pre[áa]mbulo)\b"), ("es", "PART", 0, "Parte", _R), ("es", "TITLE", 1, "T[ií]tulo", _R), ("es", "CH", 2, "Cap[ií]tulo", _R), ("es", "SEC", 3, "Secci[oó]n", _D), ("es", "ART", 4, r"Art[ií]culo|Art\.?", _ES),
    ],
    "regulation": _eu(_LATIN), "directive": _eu(_SHORT),
    "treaty": [
        ("en", "PART", 0, "Part", _R), ("en", "PROTOCOL", 0, "Protocol", _RL), ("en", "TITLE", 1, "Title", _R), ("en", "CH", 2, "Chapter", _R), ("en", "SEC", 2, "Section", _D), ("en", "ART", 3, "Article", r"[IVXLCDM]+|" + _EN + _SHORT), ("en", "ANNEX", 0, "Annex", _RL),
        ("fr", "PART", 0, "Partie", _R), ("fr", "PROTOCOL", 0, "Protocole", _RL), ("fr", "TITLE", 1, "Titre", _R, _TH), ("fr", "CH", 2, "Chapitre", _R, _TH), ("fr", "ART", 3, r"Article|Art\.?", _FR + _SHORT), ("fr", "ANNEX", 0, "Annexe", _RL),
        ("de", "PART", 0, "Teil", _R), ("de", "PROTOCOL", 0, "Protokoll", _RL), ("de", "TITLE", 1, "Titel", _R), ("de", "CH", 2, "Kapitel", _R), ("de", "ART", 3, r"Artikel|Art\.?", _EN),
        ("es", "PART", 0, "Parte", _R), ("es", "PROTOCOL", 0, "Protocolo", _RL), ("es", "TITLE", 1, "T[ií]tulo", _R), ("es", "CH", 2, "Cap[ií]tulo", _R), ("es", "ART", 3, r"Art[ií]culo|Art\.?", _ES),
    ],
    "statute": [
        ("en", "PART", 0, "Part", _R), ("en", "SCHEDULE", 0, "Schedule", _RL), ("en", "DIV", 1, "Division", _R), ("en", "SEC", 2, "Section", _DD), ("en", "SEC", 2, r"(?i)^\s*(\d+[A-Za-z]?(?:\.\d+)?)\.\s+.+$"), ("en", "SUBSEC", 3, r"(?i)^\s*\((\d{1,3}[a-z]?)\)\s+.+$"), ("en", "PARA", 4, r"(?i)^\s*\(([a-z])\)\s+.+$"), ("en", "SUBPARA", 5, r"(?i)^\s*\(([ivxlcdm]+)\)\s+.+$"),
        ("fr", "PART", 0, "Partie", _R), ("fr", "TITLE", 1, "Titre", _R, _TH), ("fr", "CH", 1, "Chapitre", _R, _TH), ("fr", "ART", 2, r"Article|Art\.?", _FR + _SHORT), ("fr", "SEC", 2, "Section", _D), ("fr", "ANNEX", 0, "Annexe", _R),
        ("de", "PART", 0, "Teil", _R), ("de", "SEC", 1, "Abschnitt", _R), ("de", "SEC", 2, r"(?i)^.{0,8}?\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("de", "SUBSEC", 3, r"(?i)^\s*\((\d{1,3}[a-z]?)\)\s+.+$"),
        ("es", "TITLE", 1, "T[ií]tulo", _R), ("es", "CH", 1, "Cap[ií]tulo", _R), ("es", "ART", 2, r"Art[ií]culo|Art\.?", _ES), ("es", "ANNEX", 0, "Anexo", _R),
    ],
    "judgment": [
        ("en", "SECT", 0, r"(?i)^(Facts|Background|Procedural\s+History|Legal\s+Context|Issues|Questions?\s+Presented|Reasoning|Analysis|Discussion|Findings|Conclusion|Disposition|Holding|Order|Costs)$"),
        ("fr", "SECT", 0, r"(?i)^(Faits(?:\s+et\s+proc[ée]dure)?|Expos[ée]\s+du\s+litige|Rappel\s+des\s+faits|Contexte|Proc[ée]dure|Moyens|Pr[ée]tentions(?:\s+des\s+parties)?|Discussion|Motivation|Motifs(?:\s+de\s+la\s+d[ée]cision)?|Sur\s+ce|Dispositif|Par\s+ces\s+motifs|D[ée]pens)\s*[:,]?$"),
        ("de", "SECT", 0, r"(?i)^(Sachverhalt|Tatbestand|Entscheidungsgr(?:ü|ue)nde|Gr(?:ü|ue)nde|Tenor|Kosten)$"), ("es", "SECT", 0, r"(?i)^(Hechos|Antecedentes|Fundamentos|Considerandos|Fallo|Costas)$"),
        *[(x, "PARA", 2, f) for x in ("en", "fr", "de", "es") for f in (r"^\[(\d{1,4})\]\s+.+$", r"^(\d{1,4})\.\s+.+$")], ("en", "SUBPARA", 3, r"(?i)^\(([a-z]|[ivxlcdm]+)\)\s+.+$"),
    ],
    "contract": [
        ("en", "SCHEDULE", 0, "Schedule|Exhibit|Appendix", _RL), ("en", "PART", 1, "Part", _R), ("en", "CL", 2, r"Clause|Cl\.?", _C), ("en", "SEC", 2, "Section", _DD), ("en", "ART", 2, "Article", _EN), ("en", "SUBCL", 3, r"(?i)^\s*\(([a-z]|\d{1,3}[a-z]?|[ivxlcdm]+)\)\s+.+$"),
        ("fr", "SCHEDULE", 0, "Annexe|Pièce", _RL), ("fr", "PART", 1, "Partie", _R), ("fr", "ART", 2, r"Article|Art\.?", _FR), ("fr", "CL", 2, "Clause", _C),
        ("de", "SCHEDULE", 0, "Anlage|Anhang", _RL), ("de", "SEC", 2, r"(?i)^.{0,8}?\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("de", "SUBCL", 3, r"(?i)^\s*\((\d{1,3}[a-z]?)\)\s+.+$"),
        ("es", "SCHEDULE", 0, "Anexo|Ap[ée]ndice", _RL), ("es", "CL", 2, "Cl[áa]usula", _C), ("es", "ART", 2, r"Art[ií]culo|Art\.?", _ES),
    ],
    "unknown": [
        ("en", "ART", 4, r"Article|Art\.?", r"[IVXLCDM]+|" + _EN + _LATIN), ("en", "SEC", 3, r"(?i)^.{0,8}?\b(?:Section|Sec\.?|§)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("en", "CL", 3, r"Clause|Cl\.?", _C), ("en", "PARA", 4, r"(?i)^\s*(\d{1,4}[A-Za-z]?)\.\s+.+$"), ("en", "SUBPARA", 5, r"(?i)^\s*\((\d{1,3}[a-z]?|[a-z]|[ivxlcdm]+)\)\s+.+$"),
        ("en", "CH", 1, r"Chapter|Ch\.?", _R), ("en", "TITLE", 0, r"Title|Tit\.?", _R), ("en", "PART", 0, r"Part|Pt\.?", _R), ("en", "SCHEDULE", 0, "Schedule|Annex|Exhibit|Appendix", _RL),
        ("fr", "ART", 4, r"Article|Art\.?", _FR + _SHORT), ("fr", "SEC", 3, "Section", _D), ("fr", "TITLE", 0, "Titre", _R, _TH), ("fr", "CH", 1, "Chapitre", _R, _TH), ("fr", "PART", 0, "Partie", _R), ("fr", "SCHEDULE", 0, "Annexe|Pièce", _RL),
        ("de", "ART", 4, r"Artikel|Art\.?", _EN), ("de", "SEC", 3, r"(?i)^.{0,8}?\b(?:§|Paragraph)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("de", "CH", 1, "Kapitel|Abschnitt", _R), ("de", "PART", 0, "Teil", _R),
        ("es", "ART", 4, r"Art[ií]culo|Art\.?", _ES), ("es", "SEC", 3, "Secci[oó]n", _D), ("es", "CH", 1, "Cap[ií]tulo", _R),
    ],
}


def _pattern(row: tuple) -> str:
    return row[3] if len(row) == 4 else rf"(?i)^.{{0,8}}?\b(?:{row[3]})\s+({row[4]}){row[5] if len(row) > 5 else ''}\b"


def _found_at(pattern: str, text: str = "t") -> str:
    """0-based place of the first match, or null."""
    return f"nullif(strpos(t, nullif(regexp_extract({text}, {quoted(pattern)}, 0), '')), 0) - 1"


def _by_language(forms: dict[str, str], text: str = "t") -> str:
    return "case lang " + " ".join(f"when '{x}' then {_found_at(p, text)}" for x, p in forms.items()) + " end"


_CLOSE = {"en": r"(?i)\b(?:IN\s+WITNESS\s+WHEREOF|Done\s+at)\b", "fr": r"(?i)\b(?:EN\s+FOI\s+DE\s+QUOI|Fait\s+à)", "de": r"(?i)\b(?:ZU\s+URKUND\s+DESSEN|Geschehen\s+zu)\b", "es": r"(?i)\b(?:EN\s+FE\s+DE\s+LO\s+CUAL|Hecho\s+en)\b"}
_SIGN = {
    "en": r"(?i)\b(?:IN\s+WITNESS\s+WHEREOF|SIGNED\s+(?:by|for\s+and\s+on\s+behalf\s+of)|EXECUTED\s+(?:as\s+a\s+deed|on\s+the\s+date))\b", "fr": r"(?i)\b(?:FAIT\s+A|SIGNE|EN\s+FOI\s+DE\s+QUOI)\b",
    "de": r"(?i)\b(?:UNTERSCHRIFT|UNTERZEICHNET|ORT,\s+DATUM)\b", "es": r"(?i)\b(?:FIRMADO|FIRMA|EN\s+FE\s+DE\s+LO\s+CUAL|HECHO\s+EN)\b",
}
_CLOSE["fr"] = r"(?i)\b(?:EN\s+FOI\s+DE\s+QUOI\b)"  # no word boundary follows the accented letter of the other marker
_ENACT = {"en": r"(?i)\b(?:Be\s+it\s+enacted|ENACTED)\s+by\b", "fr": r"(?i)\bL'?Assemblée\s+nationale\s+a\s+adopt", "de": r"(?i)\b(?:hat\s+(?:der\s+)?Bundestag\s+(?:das\s+)?folgende\s+Gesetz\s+beschlossen|verkündet)\b", "es": r"(?i)\b(?:Las\s+Cortes\s+Generales\s+han\s+aprobado|se\s+promulga)\b"}
_BODY = r"\b(?:Part|PART|Section|SECTION|Schedule|SCHEDULE|Article|ARTICLE)\s+([IVXLCDM]+|\d+)"


def _ended(kind: str) -> str:
    """The elements of a type with their ends and parents, as the table ``ended``."""
    rows = ", ".join(f"('{r[0]}', {n}, '{r[1]}', {r[2]}, {quoted(_pattern(r))})" for n, r in enumerate(_ROWS[kind]))
    start = f"case when ({_by_language(_ENACT, 'substr(t, 1, 3000)')}) is null then 0 else coalesce({_found_at(_BODY)}, least(1500, length(t))) end" if kind == "statute" else "0"
    stop = f"coalesce({_by_language(_CLOSE if kind == 'treaty' else _SIGN)}, length(t) + 1)" if kind in ("treaty", "contract") else "length(t) + 1"
    constitution = kind == "constitution"
    heading = "case when type = 'PREAMBLE' or suffix(m, '.') then m else m || '.' end" if constitution else "line"
    level = "case when type = 'ART' and regexp_full_match(ident, '(?i)[IVXLCDM]+') then 1 else level end" if constitution else "level"
    offset = "strpos(line, m) - 1" if constitution else "0"
    whole = "trim(regexp_extract(line, replace(pattern, '(?i)^.{0,8}?', '(?i)') || '\\.?', 0))" if constitution else "line"
    blocks = ""
    if kind == "unknown":
        blocks = """ union all select doc_id, 'BLOCK', 9, n::varchar, sum(length(b) + 2) over (partition by doc_id order by i) - length(b) - 2, n - 1, b, t from (
          select *, row_number() over (partition by doc_id order by i) as n from (select doc_id, t, unnest(string_split(t, chr(10) || chr(10))) as b, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) as i from docs where doc_id not in (select doc_id from els)))"""
    end = "coalesce((select min(b.position) from every b where b.doc_id = e.doc_id and b.position > e.position and (b.level between 0 and e.level or (b.type = e.type and b.level = e.level))), length(e.t))"
    if kind == "unknown":
        end = f"case when e.type = 'BLOCK' then e.position + length(e.heading) else {end} end"
    return f"""with {_docs(kind)}, placed as (select *, {start} as start, {stop} as stop from docs),
      parts as (select doc_id, t, lang, start, stop, unnest(string_split(substr(t, (start + 1)::bigint), chr(10))) as line, generate_subscripts(string_split(substr(t, (start + 1)::bigint), chr(10)), 1) - 1 as line_no from placed),
      lines as (select *, start + coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as position from parts),
      forms(lang, ord, type, level, pattern) as (values {rows}),
      hits as (select l.*, f.ord, f.type, f.level, f.pattern, regexp_extract(l.line, f.pattern, 1) as ident from lines l join forms f on f.lang = l.lang and regexp_matches(l.line, f.pattern) where l.position < l.stop and l.line <> ''),
      one as (select *, {whole} as m from hits qualify row_number() over (partition by doc_id, line_no order by ord) = 1),
      els as (select doc_id, type, {level} as level, case when type = 'PREAMBLE' then 'PREAMBLE' else trim(ident) end as identifier, position + {offset} as position, line_no, {heading} as heading, t from one),
      every as (select doc_id, type, level, identifier, position, line_no, heading, t from els{blocks}),
      ended as (select e.*, {end} as end_position, (select max(b.position) from every b where b.doc_id = e.doc_id and b.position < e.position and b.level < e.level) as tree_parent from every e)"""


_CONTENT = tidied("case when type = 'BLOCK' then heading else substr(t, (position + length(heading) + 1)::bigint, greatest(end_position - position - length(heading), 0)::bigint) end")


def _elements(kind: str) -> str:
    tail = "" if kind == "judgment" else f", end_position::int as end_position, tree_parent::int as tree_parent, length({_CONTENT})::int as char_length, length({_CONTENT}) < 20 as is_empty"
    return f"{_ended(kind)} select doc_id, type, level::int as level, identifier, position::int as position, line_no::int as line_no{tail} from ended"


# References: (language, element, kind, form); those of every type, then those of each.
_EVERY = [
    ("en", "ART", "article", r"\b(?:Article|Art\.?)\s+([IVXLCDM]+|" + _EN + _LATIN + r")\b"), ("en", "SEC", "section", r"\b(?:Section|Sec\.?)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("en", "CH", "chapter", r"\b(?:Chapter|Ch\.?)\s+([IVXLCDM]+|\d+)\b"), ("en", "TITLE", "title", r"\b(?:Title|Tit\.?)\s+([IVXLCDM]+|\d+)\b"),
    ("en", "PART", "part", r"\b(?:Part|Pt\.?)\s+([IVXLCDM]+|\d+)\b"), ("en", "PARA", "paragraph", r"\b(?:paragraphs?|para\.?)\s*(\d+[A-Za-z]?)\b"), ("en", "CL", "clause", r"\b(?:clauses?|cl\.?)\s+(\d+[A-Za-z]?)\b"), ("en", "SCHEDULE", "schedule", r"\b(?:schedules?|sch\.?)\s+([IVXLCDM]+|\d+)\b"),
    ("fr", "ART", "article", r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?" + _TO + _LATIN + r")\b"), ("fr", "TITLE", "title", r"\btitre\s+([IVXLCDM]+|\d+)(?:er)?\b"), ("fr", "CH", "chapter", r"\bchapitre\s+([IVXLCDM]+|\d+)(?:er)?\b"), ("fr", "SEC", "section", r"\bsection\s+(\d+[A-Za-z]?)\b"), ("fr", "PARA", "paragraph", r"\balin[ée]as?\s+(\d+[A-Za-z]?)\b"),
    ("de", "ART", "article", r"\b(?:Artikel|Art\.?)\s+(" + _EN + r")\b"), ("de", "SEC", "section", r"\bAbschnitt\s+([IVXLCDM]+|\d+)\b"), ("de", "PARA", "paragraph", r"\b(?:Absatz|Abs\.?|Abs(?:ä|ae)tze)\s+(\d+[A-Za-z]?)\b"), ("de", "SENTENCE", "sentence", r"\bSatz\s+(\d+)\b"),
    ("es", "ART", "article", r"\b(?:art[íi]culo|Art\.?)\s+(" + _ES + r")\b"), ("es", "TITLE", "title", r"\bt[íi]tulo\s+([IVXLCDM]+|\d+)\b"), ("es", "CH", "chapter", r"\bcap[íi]tulo\s+([IVXLCDM]+|\d+)\b"), ("es", "SEC", "section", r"\bsecci[óo]n\s+(\d+[A-Za-z]?)\b"), ("es", "PARA", "paragraph", r"\bapartados?\s+(\d+[A-Za-z]?)\b"),
]
_OWN = {
    "treaty": [("en", "PROTOCOL", "protocol", r"\bProtocol\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("en", "ANNEX", "annex", r"\bAnnex\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("en", "TREATY", "treaty", r"\b(?:Convention|Treaty|Agreement)\s+(?:of\s+)?(\d{4})\b"), ("fr", "PROTOCOL", "protocol", r"\bProtocole\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("fr", "ANNEX", "annex", r"\bAnnexe\s+([IVXLCDM]+|\d+|[A-Z])\b")],
    "contract": [
        ("en", "CL", "clause", r"\b(?:clause|Cl\.?)\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"), ("en", "SEC", "section", r"\b(?:section|s\.)\s+(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("en", "SCHEDULE", "schedule", r"\b(?:schedule|Sch\.?|exhibit|appendix)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("en", "ART", "article", r"\b(?:article|Art\.?)\s+(\d{1,4})\b"),
        ("fr", "CL", "clause", r"\bclause\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"), ("fr", "ART", "article", r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?)\b"), ("de", "SEC", "section", r"\bParagraph\s*(\d+[A-Za-z]?)\b"), ("es", "CL", "clause", r"\bcl[áa]usula\s+(\d{1,4}[A-Za-z]?(?:\.\d+)?)\b"),
    ],
    "statute": [
        ("en", "SEC", "section", r"\b(?:section|s\.|ss\.)\s*(\d+[A-Za-z]?(?:\.\d+)?)\b"), ("en", "SUBSEC", "subsection", r"\b(?:subsection|sub-s\.)\s*\(?(\d{1,3}[a-z]?)\)?\b"), ("en", "SCHEDULE", "schedule", r"\b(?:schedule|Sch\.?)\s+([IVXLCDM]+|\d+|[A-Z])\b"), ("en", "PART", "part", r"\b(?:part|Pt\.?)\s+([IVXLCDM]+|\d+)\b"), ("en", "PARA", "paragraph", r"\b(?:paragraph|para\.?)\s+\(?([ivxlcdm]+|\d+[A-Za-z]?)\)?\b"),
        ("fr", "ART", "article", r"\b(?:article|Art\.?)\s+(\d{1,4}(?:er)?" + _TO + r")\b"), ("fr", "SEC", "section", r"\bsection\s+(\d+[A-Za-z]?)\b"), ("fr", "ANNEX", "annex", r"\bannexe\s+([IVXLCDM]+|\d+)\b"),
        ("de", "SEC", "section", r"\b(?:Paragraph|Abschnitt)\s*(\d+[A-Za-z]?(?:\s*[A-Za-z])?)\b"), ("de", "SUBSEC", "subsection", r"\b(?:Absatz|Abs\.?)\s*\(?(\d{1,3}[a-z]?)\)?\b"), ("es", "ART", "article", r"\b(?:art[íi]culo|Art\.?)\s+(\d{1,4}[A-Za-z]?[°º]?)\b"),
    ],
    "judgment": [
        ("en", "PARA", "paragraph", r"\b(?:paragraph|para\.?)\s+\[?(\d{1,4})\]?\b"), ("en", "CASE", "case", r"\bCase\s+(?:No\.?|C-)?(\d+/\d+\s*P?)\b"), ("en", "ART", "article", r"\bArticle\s+([IVXLCDM]+|\d{1,4}[A-Za-z]?)\b"),
        ("fr", "PARA", "paragraph", r"\b(?:point|paragraphe)\s+\[?(\d{1,4})\]?\b"), ("fr", "CASE", "case", r"\baffaire\s+(C-?\d+/\d+)\b"),
    ],
    "unknown": [],
}
# Elements whose text is searched, and whether those that hold deeper ones are left out.
_SEARCHED = {"treaty": ("'ART', 'SEC', 'PROTOCOL', 'ANNEX'", True), "contract": ("'CL', 'SEC', 'ART', 'SUBCL', 'SCHEDULE'", True), "statute": ("'SEC', 'ART', 'SUBSEC', 'PARA', 'SCHEDULE', 'ANNEX'", True), "judgment": ("'SECT', 'PARA', 'SUBPARA'", False), "unknown": (None, False)}


def _offsets(source: str, text: str) -> str:
    """Rows of a table with columns n (its row) and pattern, for each match in ``text``: whole, target and 0-based place."""
    return f"""(select n, ord, unnest(regexp_extract_all({text}, '(?i)' || pattern, 0)) as whole, unnest(regexp_extract_all({text}, '(?i)' || pattern, 1)) as target, generate_subscripts(regexp_extract_all({text}, '(?i)' || pattern, 0), 1) as i, string_split_regex({text}, '(?i)' || pattern) as pieces from {source})"""


def _xrefs(kind: str) -> str:
    """References from the elements of a type: of two forms that find the same target at the same place one counts."""
    allowed, nested = _SEARCHED[kind]
    rows = ", ".join(f"('{r[0]}', {n}, '{r[1]}', '{r[2]}-reference', {quoted(r[3])})" for n, r in enumerate(_EVERY + _OWN[kind]))
    where = (f"and type in ({allowed})" if allowed else "") + (" and not exists (select 1 from ended b where b.doc_id = e.doc_id and b.position > e.position and b.position < e.end_position and b.level > e.level)" if nested else "")
    simple = lambda c: f"case when regexp_full_match({c}, '\\d+') then lpad({c}, greatest(4, length({c}))::int, '0') else upper({c}) end"
    inline = "regexp_extract(heading, '^(?:\\[\\d+\\]|\\d+\\.|\\([A-Za-z]+\\))\\s+(.+)$', 1)"
    content, least = (f"case when {inline} = '' then {_CONTENT} else {replaced(f'{inline} || chr(10) || {_CONTENT}', ('^[ \\t\\n]+|[ \\t\\n]+$', ''))} end", 5) if kind == "judgment" else (_CONTENT, 20)
    return f"""{_ended(kind)}, texts as (select *, {content} as content from ended), searched as (select e.*, row_number() over () as n, d.lang from texts e join docs d using (doc_id) where length(content) >= {least} {where}),
      refs(lang, ord, prefix, kind, pattern) as (values {rows}),
      tries as (select s.n, s.content, r.ord, r.pattern from searched s join refs r on r.lang = s.lang and regexp_matches(s.content, '(?i)' || r.pattern)),
      found as (select n, ord, whole, target, i, pieces, sum(length(pieces[i])) over w + sum(length(whole)) over w - length(whole) as place from {_offsets("tries", "content")} window w as (partition by n, ord order by i))
      select distinct s.doc_id, s.position::int as source_position, s.type as source_type, r.prefix, trim(f.target) as target, r.kind, (s.position + f.place)::int as position from found f join searched s using (n) join refs r on r.ord = f.ord
      where not (r.prefix = s.type and {simple("trim(f.target)")} = {simple("s.identifier")})"""


# --- metadata ---

_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_MOIS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
_ENGLISH, _FRENCH, _ISO, _FIGURES = rf"(?i)\b\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+(?:{_MOIS})\s+\d{{4}}\b", r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b", r"\b\d{1,2}[-/.]\d{1,2}[-/.]\d{4}\b"
_LOOSE = r"(?i)\b\d{1,2}\s+(?:janvier|f[ée]vrier|mars|avril|mai|juin|juillet|ao[ûu]t|septembre|octobre|novembre|d[ée]cembre)\s+\d{4}\b"


def _first(*patterns: str, group: int = 0, scope: str = "head") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({scope}, {quoted(p)}, {group}), '')" for p in patterns) + ")"


def _when(*pairs: tuple[str, str], scope: str = "head") -> str:
    return "case " + " ".join(f"when regexp_matches({scope}, {quoted(p)}) then {quoted(v)}" for p, v in pairs) + " end"


def _sentence(c: str) -> str:
    return f"upper(substr(trim({c}), 1, 1)) || lower(substr(trim({c}), 2))"


def _metadata(kind: str, lines: int, fields: dict[str, str], title: str, least: int, most: int, rule: str, none: str | None = None, hidden: tuple[str, ...] = ()) -> str:
    skip = f"and not regexp_matches(line, {quoted(none)})" if none else ""
    letters, capitals = "length(regexp_replace(line, '[^A-Za-zÀ-ÿ]', '', 'g'))", "length(regexp_replace(line, '[^A-ZÀ-Ý]', '', 'g'))"
    rule = rule.replace("@share", f"(case when {letters} = 0 then null else {capitals} / {letters} end)")
    columns = ", ".join(f"{v} as {k}" for k, v in fields.items())
    return f"""with {_docs(kind)}, heads as (select *, array_to_string(string_split(t, chr(10))[1:{lines}], chr(10)) as head from docs),
      top as (select doc_id, unnest(string_split(head, chr(10))) as line, generate_subscripts(string_split(head, chr(10)), 1) as n from heads),
      named as (select doc_id, arg_min(line, n) as line from top where length(line) between {least} and {most} {skip} and ({rule}) group by 1),
      got as (select h.*, n.line as title_line, {columns} from heads h left join named n using (doc_id))
      select doc_id, {title} as title, {", ".join(c for c in fields if c not in hidden)} from got"""


_FR1958 = r"(?i)\bConstitution\s+du\s+4\s+octobre\s+1958\b"
_US = " and ".join(f"regexp_matches(substr(t, 1, 24000), '(?i){p}')" for p in (r"\bWe\s+the\s+People\s+of\s+the\s+United\s+States\b", r"\bConstitution\b", r"\bArticle\s+I\b", r"\bArticle\s+II\b", r"\bArticle\s+III\b"))


def _known(us: str, fr: str, otherwise: str = "null") -> str:
    return f"case when {_US} then {us} when regexp_matches(substr(t, 1, 24000), {quoted(_FR1958)}) then {fr} else {otherwise} end"


_COUNTRY = _when((r"(?i)\b(?:France|République\s+française|French)\b", "France"), (r"(?i)\b(?:United\s+States|America)\b", "United States"), (r"(?i)\b(?:Germany|Deutschland)\b", "Germany"), (r"(?i)\b(?:Spain|España)\b", "Spain"), (r"(?i)\b(?:India|Bharat)\b", "India"), (r"(?i)\b(?:Canada|Canadian)\b", "Canada"), (r"(?i)\bAustralia\b", "Australia"))
_CONSTITUTION = {
    "known": _known("'Constitution of the United States'", "'Constitution du 4 octobre 1958'"), "short_title": _known("'U.S. Constitution'", "'Constitution française'"), "jurisdiction": _known("'United States'", "'France'", _COUNTRY), "authority": _known("'Constituent authority'", "'Constituent authority'"),
    "adoption_date": _known("'17 September 1787'", "'4 octobre 1958'", _first(_ENGLISH, _FRENCH, _ISO, _FIGURES)), "reference": _known("'US-CONST'", "'FR-CONST-1958'"),
}
_COURT = "case when court0 = 'Cour de cassation' then court0 else court0 end".replace("court0", "trim(regexp_replace(" + _first(
    r"(?i)\bJUDGMENT\s+OF\s+THE\s+(?:COURT|TRIBUNAL|CHAMBER)\b",
    r"(?i)\b(?:Court\s+of\s+(?:Justice|Appeal|First\s+Instance|Cassation)|Supreme\s+Court|Constitutional\s+Court|High\s+Court|District\s+Court|European\s+Court\s+of\s+(?:Justice|Human\s+Rights)|International\s+Court\s+of\s+Justice|Arbitral\s+Tribunal)\b",
    r"(?i)\b(?:Cour\s+(?:de\s+(?:justice|cassation)|d'appel|administrative\s+d'appel|européenne)|Conseil\s+d['’][ÉE]tat|Conseil\s+constitutionnel|Tribunal\s+(?:judiciaire|administratif|de\s+commerce|correctionnel))\b",
    r"(?i)\b(?:Bundesgerichtshof|Bundesverfassungsgericht|Oberlandesgericht|Landgericht|Amtsgericht)\b", r"(?i)\b(?:Tribunal\s+(?:Supremo|Constitucional|de\s+Justicia)|Corte\s+(?:Suprema|Constitucional))\b") + r", '\s+', ' ', 'g'))")
_FORMATION = [r"(?i)\b(Assembl[ée]e\s+pl[ée]ni[èe]re|Chambre\s+(?:mixte|commerciale|sociale|criminelle)|(?:Premi|Deuxi|Troisi)[èe](?:re|me)\s+chambre\s+civile)\b"]
_NUMBERS = [
    (r"(?i)\bCase\s+(?:No\.?\s*)?(C-?\d+/\d+(?:\s*P)?)\b", 1), (r"(?i)\b\[?\d{4}\]?\s+(?:UKSC|UKHL|UKPC|EWCA|EWHC)\s+\d+\b", 0), (r"(?i)\b(?:N[°º]?\s*RG|RG\s*n[°º]?|N[°º]?\s*Portalis|R[ée]pertoire\s+g[ée]n[ée]ral|Minute\s+n[°º]?|Dossier\s+n[°º]?)\s*[:\-]?\s*[A-Z0-9/\-. ]{4,}\b", 0),
    (r"(?i)\bN[°º]\s+de\s+pourvoi\s*:\s*([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b", 1), (r"(?i)\bn[°º]\s*([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b", 1), (r"\b([0-9]{2,4}-[0-9]{2}\.[0-9]{3})\b", 1), (r"(?i)\bDTA\s*\d{4,}\s*\d{8}\b", 0), (r"(?i)\b(?:No\.?|Nr\.?|n°)\s*\d[\d/\-.]+\b", 0),
]
# The opening counts first where the document has a case header; both are the same text or the opening holds more lines.
_CASE = "trim(regexp_replace(regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract({{0}}, {quoted(p).replace('{', '{{').replace('}', '}}')}, {g}), '')" for p, g in _NUMBERS) + "), '(?i)^(?:pourvoi\\s+)?n[°º]\\s*', ''), '\\s+', ' ', 'g'))"
_DEADLINE = r"(?i)\b(?:by|before|no\s+later\s+than|from)\s+(\d{1,2}\s+\w+\s+\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b"

_EU = {
    "jurisdiction": _when((r"(?i)European\s+Union|\(EU\)|\bEU\b", "European Union")),
    "adopting_body": _first(r"(?i)\b(European\s+Parliament\s+and\s+(?:of\s+)?the\s+Council|Council\s+of\s+the\s+European\s+Union|European\s+Commission)\b", group=1),
}
_REGULATION = {"regulation_number": "'Regulation (EU) ' || " + _first(r"(?i)\bRegulation\s+\(EU\)\s+(?:No\.?\s*)?(\d{4}/\d{1,4})\b", r"(?i)\bRèglement\s+\(UE\)\s+(?:n°?\s*)?(\d{4}/\d{1,4})\b", group=1), "jurisdiction": _EU["jurisdiction"], "adoption_date": _first(_ENGLISH, _FRENCH, _ISO, _FIGURES), "adopting_body": _EU["adopting_body"]}
_DIRECTIVE = {
    "directive_number": "'Directive ' || " + _first(r"(?i)\bDirective\s+\(?(?:EU|EC|EEC)?\)?\s*(?:No\.?\s*)?(\d{4}/\d{1,4}/?(?:EU|EC|EEC)?)\b", group=1), "jurisdiction": _EU["jurisdiction"], "adoption_date": _first(_ENGLISH), "adopting_body": _EU["adopting_body"],
    "transposition_deadline": f"case when regexp_matches(substr(t, greatest(1, {_found_at(_DEADLINE)} - 139)::bigint, least({_found_at(_DEADLINE)}, 140) + length(regexp_extract(t, {quoted(_DEADLINE)}, 0)) + 140), '(?i)transpos|Member\\s+States\\s+shall|adopt\\s+and\\s+publish') then nullif(regexp_extract(t, {quoted(_DEADLINE)}, 1), '') end",
}
_STATUTE = {
    "short_title": "trim(" + _first(r"(?i)\bThis\s+Act\s+may\s+be\s+cited\s+as\s+(?:the\s+)?(.+?)(?:\.|\n)", group=1, scope="t") + ")", "act_number": _first(r"(?i)\b(?:Act\s+No\.?\s*\d+\s+of\s+\d{4}|Public\s+Law\s+\d{2,3}[-–]\d{1,4})\b"),
    "jurisdiction": _when((r"(?i)\b(?:United\s+Kingdom|UK)\b", "United Kingdom"), (r"(?i)\b(?:United\s+States|Congress|USC|Public\s+Law)\b|\bU\.S\.C\.\w", "United States"), (r"(?i)\bCanada\b", "Canada"), (r"(?i)\b(?:Australia)\b", "Australia"), (r"(?i)\b(?:France|République\s+française|Assemblée\s+nationale|Sénat)\b", "France"), (r"(?i)\b(?:Germany|Deutschland|Bundestag|Bundesrepublik)\b", "Germany")),
    "adoption_date": _first(_ENGLISH, _ISO),
}
_CONTRACT = {
    "contract_type": _first(r"(?i)\b(Master\s+Services?\s+Agreement|Service\s+Level\s+Agreement|Non-Disclosure\s+Agreement|(?:Employment|Lease|Purchase|License|Distribution|Partnership)\s+Agreement|Agreement|Contract)\b", group=1),
    "agreement_date": "coalesce(" + _first(r"(?i)\b(?:dated|made|entered\s+into)\s+(?:as\s+of\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4})\b", group=1) + ", " + _first(_ENGLISH) + ")",
}

_WORDLESS = "regexp_replace(trim({}), '\\s+', ' ', 'g')"
_UNITS = """blocks as (select extraction_id, unnest(string_split_regex(x, '\n{2,}')) as b, generate_subscripts(string_split_regex(x, '\n{2,}'), 1) as i from (select extraction_id, @ as x from (select * from extractions where raw_text is not null qualify row_number() over (partition by extraction_id order by loaded_at desc) = 1))),
  kept as (select extraction_id, i, regexp_replace(b, '^\\s+|\\s+$', '', 'g') as b from blocks), full_ as (select *, lag(b) over (partition by extraction_id order by i) as before from kept where b <> ''),
  units as (select *, row_number() over (partition by extraction_id order by i) as n from full_ where before is null or before <> b)"""


def units_sql(extract: str, select: str) -> str:
    return f"with {_UNITS.replace('@', extract.replace('@', 'raw_text'))} {select}"


UNIT_TYPE = "case when regexp_matches(b, '(?i)^(?:chapter|title|section)\\b') or regexp_matches(b, '(?i)^(?:article|amendment)\\s+(?:[ivxlcdm]+|\\d+)') then 'heading' when regexp_matches(b, '^\\(?\\d+\\)?\\s+') then 'paragraph' else 'block' end"
_SUFFIXES = ["BIS", "TER", "QUATER", "QUINQUIES", "SEXIES", "SEPTIES", "OCTIES", "NOVIES", "DECIES"]

_CITED = [
    ("case-citation", r"\bC(?:ase|ASE)\s+(?:No\.?\s*)?(?:C-?\d+/\d+(?:\s*P)?)\b"), ("neutral-citation", r"\b\[\d{4}\]\s+(?:UKSC|UKHL|UKPC|EWCA|EWHC|USSC|SCC)\s+\d+\b"), ("reporter-citation", r"\b\d+\s+(?:U\.S\.|F\.?\s?Supp\.?|F\.?\s?\d+d|S\.Ct\.)\s+\d+\b"),
    ("eu-law-citation", r"(?i)\b(?:Regulation|Directive)\s+\(?(?:EU|EC|EEC)?\)?\s*(?:No\.?\s*)?\d{4}/\d{1,4}/?(?:EU|EC|EEC)?\b"), ("legal-provision-citation", r"\b(?:Article|ARTICLE|Art\.?)\s+\d{1,4}[A-Za-z]?\b"),
]
_CITATIONS = f"""with {_docs("judgment")}, parsed as (select * from docs where doc_id in (select doc_id from ({_elements("judgment")}))), forms(ord, kind, pattern) as (values {", ".join(f"({n}, '{k}', {quoted(p)})" for n, (k, p) in enumerate(_CITED))}),
  found as (select doc_id, ord, forms.kind, unnest(regexp_extract_all(t, pattern, 0)) as whole, generate_subscripts(regexp_extract_all(t, pattern, 0), 1) as i, string_split_regex(t, pattern) as pieces from parsed join forms on regexp_matches(t, pattern)),
  placed as (select *, sum(length(pieces[i])) over w + sum(length(whole)) over w - length(whole) as place from found window w as (partition by doc_id, ord order by i))
  select doc_id, 'CITE-' || lpad((row_number() over (partition by doc_id order by ord, place))::varchar, 4, '0') as id, kind, trim(regexp_replace(whole, '\\s+', ' ', 'g')) as text, place::int as position from placed"""

SQL = {f"elements_{kind}": _elements(kind) for kind in _ROWS} | {f"xrefs_{kind}": _xrefs(kind) for kind in _OWN} | {
    "citations": _CITATIONS,
    "extraction_defaults": r"select extraction_id, coalesce(nullif(filename, ''), 'untitled') as filename, coalesce(nullif(extraction_method, ''), 'pre-extracted') as extraction_method, length(x)::int as characters, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))::int as words, len(list_filter(string_split_regex("
    + replaced(tidied("x"), (r"(?m)^ | $", "")) + r", '\n{2,}'), lambda b: trim(b) <> ''))::int as units from (select *, coalesce(nullif(normalized_text, ''), nullif(raw_text, ''), '') as x from extractions where extraction_id is not null qualify row_number() over (partition by extraction_id order by loaded_at desc) = 1)",
    "canonical_parts": f"""select canonical_id, regexp_extract(canonical_id, '^([^-]+)', 1) as prefix, number, case when suffix is not null then regexp_replace(number, '-[A-Z]+$', '') else number end as base, suffix from
      (select distinct canonical_id, case when contains(canonical_id, '-') then regexp_extract(canonical_id, '^[^-]+-(.*)$', 1) end as number, nullif(regexp_extract(canonical_id, '-({"|".join(_SUFFIXES)})$', 1), '') as suffix from elements where canonical_id is not null)""",
    "metadata_regulation": _metadata("regulation", 35, _REGULATION, "coalesce(title_line, regulation_number, 'Untitled Regulation')", 15, 260, r"@share > 0.55 or regexp_matches(line, '(?i)\bRegulation\s+\(EU\)')"),
    "metadata_statute": _metadata("statute", 35, _STATUTE, "coalesce(short_title, title_line, 'Untitled Statute')", 10, 220, r"(regexp_matches(line, '(?i)\b(Act|Statute|Law|Code|Bill)\b') and @share is not null) or line = upper(line)"),
    "metadata_contract": _metadata("contract", 35, _CONTRACT, "coalesce(title_line, contract_type, 'Untitled Agreement')", 10, 220, r"(regexp_matches(line, '(?i)\b(Agreement|Contract|Deed|Terms|Services|License|Lease|Purchase|Employment)\b') and @share is not null) or line = upper(line)", r"(?i)^(BETWEEN|WHEREAS|CLAUSE|SECTION|ARTICLE)\b"),
    "metadata_unknown": _metadata("unknown", 25, {"best_guess": "coalesce(" + _when((r"\b(?:Article|ARTICLE)\s+\d{1,4}\b", "Structured legal document (articles detected)"), (r"\b(?:Section|SECTION)\s+\d+\b", "Structured legal document (sections detected)"), (r"\b(?:Clause|CLAUSE)\s+\d+\b", "Structured legal document (clauses detected)"), (r"\b(?:WHEREAS|BETWEEN)\b", "Possible contract or agreement")) + ", 'Unknown legal document')"},
        "coalesce(title_line, 'Untitled Legal Document')", 10, 250, "@share > 0.4", r"(?i)^(Article|Section|Clause|Chapter|Part|Title)\b"),
    "metadata_constitution": _metadata("constitution", 20, _CONSTITUTION, "coalesce(known, title_line, 'Untitled Constitution')", 10, 220, r"@share > 0.45 or regexp_matches(line, '(?i)constitution|grundgesetz|constitución')",
        r"(?i)^(Article|Section|Part|Chapter|Title|Titre|Chapitre|Art[ií]culo|Artikel)\b|\b(?:we\s+the\s+people|in\s+order\s+to|more\s+perfect\s+union|establish\s+justice|domestic\s+tranquility|common\s+defence|general\s+welfare|blessings\s+of\s+liberty|do\s+ordain|establish\s+this\s+constitution)\b", hidden=("known",)),
    "metadata_directive": _metadata("directive", 35, _DIRECTIVE, "coalesce(title_line, directive_number, 'Untitled Directive')", 15, 260, r"@share > 0.55 or (regexp_matches(line, '(?i)\bDirective\b') and @share is not null)"),
    "metadata_judgment": f"""with {_docs("judgment")}, heads as (select *, array_to_string(string_split(t, chr(10))[1:45], chr(10)) as head, substr(t, 1, 5000) as opening from docs),
      got as (select *, {_COURT} as court, {_first(_ENGLISH, _LOOSE, _ISO)} as judgment_date, case when lang = 'fr' then {_first(*_FORMATION, group=1)} end as f, case when lang = 'fr' then {_first(r"(?i)\b(Publi[ée]\s+au\s+bulletin|Non\s+publi[ée]\s+au\s+bulletin|In[ée]dit)\b", group=1)} end as p,
        case when lang = 'fr' then coalesce({_first(r"(?i)(?:^|\n)Solution\s*:\s*([^\n.]+)", group=1, scope="t")}, {_first(r"(?i)(?:^|\n)\s*(REJETTE|CASSE(?:\s+ET\s+ANNULE)?|ANNULE)\b", group=1, scope="t")}) end as o, {_CASE.format("head")} as number from heads)
      select doc_id, court, number as case_number, judgment_date, {_sentence("f")} as formation, {_sentence("p")} as publication_status, {_sentence("o")} as outcome, case when regexp_matches(court, '(?i)Cour\\s+de\\s+cassation') then 'France' end as jurisdiction from got""",
    "source_anchors": f"""with f as (select fiche_id, extraction_id from fiches qualify row_number() over (partition by fiche_id order by loaded_at desc) = 1),
      e as (select distinct fiche_id, canonical_id, heading from elements where heading is not null), u as (select * from source_units qualify row_number() over (partition by unit_id order by loaded_at desc) = 1),
      j as (select e.*, u.unit_ref, u.page_number, u.unit_order from e join f using (fiche_id) join u using (extraction_id) where starts_with(lower({_WORDLESS.format("u.text")}), lower({_WORDLESS.format("e.heading")})) and length({_WORDLESS.format("e.heading")}) >= 1)
      select fiche_id, canonical_id, heading, unit_ref, page_number from j qualify row_number() over (partition by fiche_id, canonical_id, heading order by unit_order, unit_ref) = 1""",
    "validate_dimensions": f"select doc_id, 'classification' as stage, 'VALIDATION_CLASSIFICATION_MISSING' as code, 'origin' as detail from documents where document_type is null or document_type not in {_TYPES}",
}
