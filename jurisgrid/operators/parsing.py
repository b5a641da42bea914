"""Whole documents to structure: elements with extents and content, blocks, references, citations, relations, metadata.

A document is parsed where it lies, in one Arrow-batched pass: no text is shuffled, joined back or copied for a query that
asks only for headings. What comes out is one row a document with arrays of structs; every query over elements, references or
signals explodes the array it needs. Forms, markers and levels are the tables of :mod:`jurisgrid.functions.forms`; the engine
only knows their shapes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisgrid.functions import forms
from jurisgrid.functions.numbers import ORDINALS, SUFFIXES
from jurisgrid.functions.registry import SECTION_ROLES, TYPE_LABELS

LANGUAGES = ("en", "fr", "de", "es")
BATCH = 200  # documents in a batch that goes back to Spark
ELEMENT = (
    "id string, type string, level int, identifier string, normalized string, sort_key string, position int, end_position int, line_no int, heading string, title string, content string, char_length int, word_count int, "
    "is_empty boolean, is_annex boolean, is_amendment boolean, parent_id string, parent_role string, role string, section_id string, section_role string, tree_parent int, depth int, children int, citation string, "
    "chosen boolean, outgoing int, unresolved int, incoming int"
)
PARSED = (
    "kind string, language string, status string, title string, metadata map<string,string>, parties array<string>, warnings array<string>, summary string, document_citation string, core_units int, "
    f"elements array<struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in ELEMENT.split(', ')))}>>, "
    "blocks array<struct<key:string,id:string,type:string,heading:string,content:string,position:int,end_position:int,detail:string,citation:string>>, "
    "refs array<struct<source_id:string,source_type:string,target_id:string,target:string,prefix:string,kind:string,position:int,resolved:boolean,context:string>>, "
    "citations array<struct<id:string,kind:string,text:string,position:int,owner_id:string,owner_type:string,section_role:string,context:string>>, "
    "relations array<struct<type:string,source_id:string,target_id:string,source_ids:array<string>,target_ids:array<string>,confidence:string>>, "
    "amendments array<struct<id:string,canonical_id:string,heading:string,position:int,found_by:string>>, "
    "signals array<struct<kind:string,detail:string,id:string,heading:string,position:int>>"
)


@cache
def form(pattern: str, fold: bool = True) -> re.Pattern:
    """A form with the meaning it has in the tables: word boundaries, digits and blanks of ASCII, letters with accents folded too."""
    if fold:
        out, inside, escaped = [], False, False
        for ch in pattern:
            if ch.isascii() or ch.lower() == ch.upper() or len(ch.swapcase()) > 1:
                inside = inside if escaped else True if ch == "[" else False if ch == "]" else inside
                out.append(ch)
            else:
                both = ch.lower() + ch.upper()
                out.append(both if inside else f"[{both}]")
            escaped = ch == "\\" and not escaped
        pattern = "".join(out)
    return re.compile(pattern, re.A | re.I if fold else re.A)


_EDGE = " \t\n\x0b\f\r"
_ORDINAL_END = {"en": "st|nd|rd|th", "fr": "er|ere|ère|eme|ème|e", "de": "te|ste", "es": "°|º"}
_WORDS = {w: i for words in ORDINALS.values() for i, w in enumerate(words.split(), 1)}
_ROMAN = re.compile("^(?=[MDCLXVI])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$", re.I)
_VALUE = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
_SUFFIXED = re.compile(r"^(.+?)\s*\b(" + "|".join(SUFFIXES) + ")$", re.I)


def tidy(text: str) -> str:
    """The normal form in which parsers see text."""
    t = re.sub("[​-‍﻿]", "", re.sub("\r\n?", "\n", text).replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", re.sub(" *\n *", "\n", re.sub(r"[ \t]+", " ", t))).strip(_EDGE)


def _one_number(part: str) -> str:
    if not part:
        return "0000"
    if part.lower() in _WORDS:
        return f"{_WORDS[part.lower()]:04d}"
    if re.fullmatch(r"[0-9]+[A-Za-z]", part):
        return part[:-1].zfill(4) + part[-1].lower()
    if re.fullmatch("[0-9]+", part):
        return part.zfill(4)
    if _ROMAN.match(part):
        values = [_VALUE[c] for c in part.upper()]
        return f"{sum(-v if v < max(values[i:]) else v for i, v in enumerate(values)):04d}"
    return part.upper()


def number(raw: str, language: str) -> str:
    """Normal form of an identifier, as :func:`jurisgrid.functions.numbers.normalize_number`."""
    text = re.sub(rf"(?i)^(\d+)(?:{_ORDINAL_END[language]})$", r"\1", raw.strip().rstrip(".,;:"))
    m = _SUFFIXED.match(text)
    if m:
        return f"{_one_number(m[1].strip())}-{m[2].upper()}"
    return "-".join(_one_number(p.strip()) for p in re.split("[-–—]", text))


def _id(prefix: str, normalized: str) -> str:
    return prefix if prefix == "PREAMBLE" else f"{prefix}-{normalized}"


def _sort_key(canonical: str) -> str:
    for i, s in enumerate(SUFFIXES):
        canonical = re.sub(f"{s}$", str(998 + i).zfill(4), canonical)
    return canonical


def context(text: str, at: int, found: str, radius: int = 80) -> str:
    return " ".join(text[max(0, at - radius) : at + len(found) + radius].split())


def preview(text: str, most: int) -> str:
    t = text.strip()
    if len(t) <= most:
        return t
    back = t.rfind(" ", 0, most)
    return (t[:back] if back > 0.7 * most else t[:most]) + "..."


def first_line(text: str, most: int) -> str | None:
    return next((line for line in (x.strip() for x in text.split("\n")) if 3 < len(line) <= most), None)


def _capitals(line: str) -> float | None:
    """Share of capitals among the letters (both counted up to ÿ), or None without letters."""
    letters = re.sub("[^A-Za-zÀ-ÿ]", "", line)
    return len(re.sub("[^A-ZÀ-Ý]", "", line)) / len(letters) if letters else None


def looks_like_heading(line: str) -> bool:
    return 0 < len(line) <= 180 and (bool(re.match(r"\d+[.)]\s+", line)) or (_capitals(line) or 0) > 0.45)


def title_of_file(name: str | None) -> str | None:
    return re.sub(r"\b\w", lambda m: m[0].upper(), re.sub("[-_]+", " ", re.sub(r"\.[^.]+$", "", name)), flags=re.A) if name else None


def section_role(heading: str) -> str:
    low = heading.lower()
    return next((role for role, words in SECTION_ROLES if re.search(words, low)), "section")


def _sentence(text: str) -> str:
    t = text.strip()
    return t[:1].upper() + t[1:].lower()


def _title_after(heading: str, identifier: str) -> str | None:
    """What a heading says after its keyword and identifier."""
    m = re.match(rf"\W*(?:[^\W\d_]+\.?|§)\s*{re.escape(identifier)}\s*[.\-—:]*\s*", heading)
    rest = heading[m.end() :].strip() if m else heading
    return rest or None


# --- elements ---


def _element(kind: str, level: int, identifier: str, normalized: str, canonical: str, position: int, line_no: int | None, heading: str, **more: object) -> dict:
    return {"id": canonical, "type": kind, "level": level, "identifier": identifier.strip(), "normalized": normalized, "sort_key": _sort_key(canonical), "position": position, "end_position": None, "line_no": line_no, "heading": heading,
            "title": None, "content": "", "inline": "", "is_annex": kind in forms.ANNEXES, "is_amendment": False, "parent_id": None, "parent_role": None, "role": None, "section_id": None, "section_role": None} | more


def discover(text: str, kind: str, language: str, start: int = 0, stop: int | None = None) -> list[dict]:
    """Elements by line: the first form that begins within the first nine characters names the line's element."""
    table = [(prefix, level, form(p)) for prefix, level, p in forms.HEADINGS[kind][language]]
    found, at = [], start
    for line_no, line in enumerate(text[start:].split("\n")):
        if stop is not None and at >= stop:
            break
        bare = line.strip()
        for prefix, level, pattern in table if bare else ():
            m = pattern.search(bare)
            if not m or m.start() > 8:
                continue
            ident = "PREAMBLE" if prefix == "PREAMBLE" else m[1]
            normal = number(ident, language)
            canonical = _id(prefix, normal)
            e = _element(prefix, level, ident, normal, canonical, at, line_no, bare)
            if kind == "constitution":
                e["position"] = at + m.start()
                e["heading"] = m[0].strip() if prefix == "PREAMBLE" or m[0].strip().endswith(".") else m[0].strip() + "."
                e["is_amendment"] = prefix == "AMEND"
                e["is_annex"] = prefix == "SCHEDULE"
                if prefix == "ART" and re.fullmatch("[IVXLCDM]+", ident, re.I):
                    e["level"] = 1
            elif kind == "judgment":
                e["inline"] = e["title"] = m[2].strip() if pattern.groups > 1 and m[2] else ""
                e["title"] = e["title"] or None
                e["role"] = section_role(ident) if prefix == "SECT" else None
            else:
                e["title"] = _title_after(bare, ident)
                e["is_amendment"] = kind == "statute" and bool(re.search("amend|repeal|modif|abrog", bare, re.I))
            found.append(e)
            break
        at += len(line) + 1
    if kind == "judgment" and language == "fr":
        found += _french_blocks(text)
    found.sort(key=lambda e: e["position"])
    return _near_duplicates(found) if kind == "constitution" else _first(found, lambda e: (e["id"], e["position"]))


def _first(items: list, key) -> list:  # noqa: ANN001
    seen: set = set()
    return [x for x in items if not (key(x) in seen or seen.add(key(x)))]


def _french_blocks(text: str) -> list[dict]:
    out = []
    for name, kind, role, pattern in forms.FRENCH_BLOCKS:
        for n, m in enumerate(form(pattern).finditer(text), 1):
            canonical = name if n == 1 else f"{name}-{n}"
            label = forms.ROLE_LABELS.get(role)
            label = _sentence(role) if label is None else f"{label} {n}" if role == "reasoning" and n > 1 else label
            out.append(_element(kind, 0, canonical, canonical, canonical, m.start(1), text.count("\n", 0, m.start(1)), m[1].strip(), role=role, title=label, sort_key=f"{m.start(1):010d}-{canonical}"))
    return out


def _near_duplicates(found: list[dict]) -> list[dict]:
    """One element where two begin close together: on one line the deeper, elsewhere the first of an id."""
    out: list[dict] = []
    places: dict[str, list[int]] = {}
    for e in found:
        last = out[-1] if out else None
        if last and last["line_no"] == e["line_no"] and abs(last["position"] - e["position"]) < 8:
            if e["level"] > last["level"] or (e["type"] == "PREAMBLE" != last["type"]):
                out[-1] = e
                places.setdefault(e["id"], []).append(e["position"])
        elif not any(abs(p - e["position"]) < 25 for p in places.get(e["id"], ())):
            out.append(e)
            places.setdefault(e["id"], []).append(e["position"])
    return out


def set_extents(text: str, elements: list[dict], shortest: int = 20) -> None:
    """End, content and sizes of each element. It ends where the next of the same or a higher level begins, or of its own type and level."""
    after: dict[int, int] = {}  # level -> position of the nearest element below
    same: dict[tuple[str, int], int] = {}
    for e in reversed(elements):
        ends = [p for level, p in after.items() if 0 <= level <= e["level"]]
        if (e["type"], e["level"]) in same:
            ends.append(same[e["type"], e["level"]])
        e["end_position"] = min(ends, default=len(text))
        after[e["level"]] = same[e["type"], e["level"]] = e["position"]
        _set_content(e, tidy(text[e["position"] + len(e["heading"]) : e["end_position"]]), shortest)


def _set_content(e: dict, content: str, shortest: int) -> None:
    e["content"], e["char_length"], e["word_count"], e["is_empty"] = content, len(content), len(content.split()), len(content) < shortest


def set_tree(elements: list[dict]) -> None:
    """Parent (its position), depth and number of children: the parent is the nearest element before with a higher level."""
    open_: list[dict] = []
    for e in elements:
        while open_ and open_[-1]["level"] >= e["level"]:
            open_.pop()
        e["tree_parent"], e["depth"], e["children"] = (open_[-1]["position"] if open_ else None), len(open_), 0
        if open_:
            open_[-1]["children"] += 1
        open_.append(e)


def _inline_sections(text: str, elements: list[dict], language: str) -> list[dict]:
    """Sections within the text of an article, where they have no line of their own."""
    if language != "en":
        return []
    known = [e["position"] for e in elements if e["type"] == "SEC"]
    out = []
    for a in elements:
        if a["type"] != "ART" or a["is_amendment"]:
            continue
        for m in form(r"\bSection\s+(\d+[A-Za-z]?)\s*\.").finditer(text, a["position"] + len(a["heading"]), a["end_position"]):
            if any(abs(p - m.start()) <= 8 for p in known) or re.search(r"\(\s*note:\s*changed\s+by\s*$", text[max(0, m.start() - 48) : m.start()].lower()):
                continue
            normal = number(m[1], language)
            out.append(_element("SEC", a["level"] + 1, m[1], normal, f"{a['id']}-SEC-{normal}", m.start(), a["line_no"], m[0], parent_id=a["id"], parent_role="article"))
    return out


def _article_paragraphs(elements: list[dict]) -> list[dict]:
    """Numbered paragraphs of articles as elements below them."""
    out = []
    for a in elements:
        if a["type"] != "ART" or not a["content"]:
            continue
        for m in re.finditer(r"(?im)^\s*(?:\((\d{1,3}[a-z]?)\)|(\d{1,3}[a-z]?)[.)])\s+(.+)$", a["content"], re.A):
            ident = m[1] or m[2]
            normal = f"{a['normalized']}-PARA-{number(ident, 'en')}"
            p = _element("PARA", 3, ident, normal, f"PARA-{normal}", a["position"] + len(a["heading"]) + m.start(), a["line_no"], f"Paragraph {ident}", parent_id=a["id"])
            _set_content(p, m[3].strip(), 20)
            out.append(p)
    return sorted(elements + out, key=lambda e: e["position"])


# --- blocks ---


def _block(key: str, kind: str, heading: str, content: str, at: int | None, end: int | None, detail: str | None = None, canonical: str | None = None) -> dict:
    return {"key": key, "id": canonical or kind, "type": kind, "heading": heading, "content": content, "position": at, "end_position": end, "detail": detail}


def _body_start(text: str, kind: str) -> int:
    pattern, default = forms.BODY_STARTS[kind]
    m = form(pattern, False).search(text)
    return m.start() if m else min(default, len(text))


def front_and_end(text: str, kind: str, language: str) -> list[dict]:
    """Blocks of a document that its elements don't cover: recitals, preamble, enactment, header, signatures, closing."""
    find = lambda p: form(p).search(text)
    out = []
    if kind in forms.ENACTING:
        enacting, start, listed = find(forms.ENACTING[kind][language]), find(forms.RECITAL_STARTS[language]), re.search(r"(?m)^\s*\(\d{1,3}\)\s+", text)
        if enacting or start or listed:
            begin = min((m.start() for m in (start, listed) if m), default=0)
            end = enacting.start() if enacting else _body_start(text, kind)
            content = tidy(text[begin:end])
            if end > begin and len(content) >= 40:
                out.append(_block("recitals", "RECITALS", "Recitals", content, begin, end, str(len(re.findall(r"(?m)^\s*\(\d{1,3}\)\s+", content)))))
    elif kind == "treaty":
        start, agreed = find(forms.TREATY_STARTS[language]), find(forms.AGREED[language])
        if start or agreed:
            begin, end = start.start() if start else 0, agreed.end() if agreed else _body_start(text, kind)
            content = tidy(text[begin:end])
            if end > begin and len(content) >= 40:
                out.append(_block("preamble", "TREATY_PREAMBLE", first_line(content, 180) or "Treaty Preamble", content, begin, end))
        closing = find(forms.CLOSING[language])
        if closing:
            content = tidy(text[closing.start() :])
            out.append(_block("closing", "CLOSING", first_line(content, 180) or "Closing Formula", content, closing.start(), len(text)))
    elif kind == "statute":
        m = next((m for m in (form(p).search(text, 0, 3000) for p in forms.ENACTMENT[language]) if m), None)
        if m:
            end = _body_start(text, kind)
            out.append(_block("preamble", "ENACTMENT", "Enactment Clause", tidy(text[:end]), 0, end, m[0]))
    elif kind == "judgment":
        head = text[:5000]
        score = sum(bool(form(p).search(head)) for p in forms.CASE_HEADERS[language])
        if score:
            m = find(forms.HEADER_END) or re.search(r"(?m)^\s*\[?\d{1,4}\]?\s+", text)
            end = m.start() if m else min(3000, len(text))
            out.append(_block("header", "HEADER", "Case Header", tidy(text[:end]), 0, end, str(score)))
    elif kind == "contract":
        start, operative = find(forms.CONTRACT_RECITALS[language]), find(forms.OPERATIVE[language])
        if start:
            end = operative.end() if operative and operative.start() > start.start() else _body_start(text, kind)
            content = tidy(text[start.start() : end])
            if len(content) >= 30:
                out.append(_block("recitals", "RECITALS", "Contract Recitals", content, start.start(), end))
        signed = find(forms.SIGNATURES[language])
        if signed:
            content = tidy(text[signed.start() :])
            out.append(_block("signatures", "SIGNATURES", first_line(content, 180) or "Signature Block", content, signed.start(), len(text)))
    return out


def _constitution_preamble(text: str, elements: list[dict], language: str) -> dict | None:
    end = next((e["position"] for e in elements if e["level"] >= 0 and not e["is_annex"] and not e["is_amendment"]), min(3000, len(text)))
    content = tidy(text[:end])
    hits = sum(w in content.lower() for w in forms.PREAMBLE_WORDS[language])
    if len(content) < 50 or not hits and len(content) < 500:
        return None
    return _block("preamble", "PREAMBLE", first_line(content, 180) or "Preamble", content, 0, end, str(min(95, 45 + 10 * min(hits, 5) + (10 if len(content) > 500 else 0))))


def _disposition(text: str, elements: list[dict], language: str) -> dict | None:
    pattern = form(forms.DISPOSITIONS[language])
    e = next((e for e in elements if pattern.search(f"{e['heading']}\n{e['content']}")), None)
    if e:
        return _block("disposition", "DISPOSITION", e["heading"], "", e["position"], None, preview(f"{e['heading']} {e['content']}", 500), e["id"])
    m = pattern.search(text)
    return _block("disposition", "DISPOSITION", m[0], "", m.start(), None, context(text, m.start(), m[0], 220)) if m else None


# --- references, citations, relations ---


def cross_references(elements: list[dict], kind: str, language: str) -> list[dict]:
    """References in the text of elements (and blocks) to others; the same target at the same place counts once."""
    allowed, skip_nested = forms.REFERENCE_SOURCES[kind]
    extra = forms.TYPE_REFERENCES[kind].get(language, [] if kind in ("judgment", "constitution", "treaty") else forms.TYPE_REFERENCES[kind].get("en", []))
    table = [(form(p), prefix, name) for p, prefix, name in forms.REFERENCES[language] + extra]
    known = {e["id"] for e in elements}
    order = sorted(range(len(elements)), key=lambda i: elements[i]["position"])
    starts = [elements[i]["position"] for i in order]
    out, seen = [], set()
    for e in elements:
        if not e["content"] or e["is_empty"] or allowed and e["type"] not in allowed:
            continue
        if skip_nested and e["end_position"] is not None:
            i, nested = bisect_right(starts, e["position"]), False
            while i < len(starts) and starts[i] < e["end_position"] and not nested:
                nested = elements[order[i]]["level"] > e["level"]
                i += 1
            if nested:
                continue
        for pattern, prefix, name in table:
            for m in pattern.finditer(e["content"]):
                target = _id(prefix, number(m[1], language))
                at = e["position"] + m.start()
                if target == e["id"] or (e["id"], target, at) in seen:
                    continue
                seen.add((e["id"], target, at))
                out.append({"source_id": e["id"], "source_type": e["type"], "target_id": target, "target": m[1].strip(), "prefix": prefix, "kind": name, "position": at, "resolved": target in known, "context": context(e["content"], m.start(), m[0])})
    return out


def _count_references(elements: list[dict], refs: list[dict], units: tuple[str, ...] | None) -> None:
    """Numbers of references from and to each element, and the one element that stands for an id: the first core unit with text, else the first."""
    out: dict[str, int] = {}
    lost: dict[str, int] = {}
    into: dict[str, int] = {}
    for r in refs:
        out[r["source_id"]] = out.get(r["source_id"], 0) + 1
        lost[r["source_id"]] = lost.get(r["source_id"], 0) + (not r["resolved"])
        into[r["target_id"]] = into.get(r["target_id"], 0) + 1
    seen: set[str] = set()
    for e in sorted(elements, key=lambda e: e["is_empty"] or units is not None and e["type"] not in units):
        e["chosen"] = e["id"] not in seen
        seen.add(e["id"])
        e["outgoing"], e["unresolved"], e["incoming"] = out.get(e["id"], 0), lost.get(e["id"], 0), into.get(e["id"], 0)


def owner(elements: list[dict], at: int) -> dict | None:
    """The narrowest element that holds a position, both ends included; of equal ones the deeper."""
    held = [e for e in elements if e["end_position"] is not None and e["position"] <= at <= e["end_position"]]
    return min(held, key=lambda e: (e["end_position"] - e["position"], -e["level"]), default=None)


def judgment_citations(text: str, elements: list[dict]) -> list[dict]:
    out = []
    for pattern, kind, exact in forms.CITATIONS:
        for m in form(pattern, not exact).finditer(text):
            e = owner(elements, m.start())
            out.append({"id": f"CITE-{len(out) + 1:04d}", "kind": kind, "text": " ".join(m[0].split()), "position": m.start(), "owner_id": e and e["id"], "owner_type": e and e["type"], "section_role": e and (e["section_role"] or e["role"]), "context": context(text, m.start(), m[0], 120)})
    return _first(out, lambda c: (c["kind"], c["text"], c["position"]))


def _relation(kind: str, source: str | None = None, target: str | None = None, sources: list[str] | None = None, targets: list[str] | None = None, confidence: str | None = None) -> dict:
    return {"type": kind, "source_id": source, "target_id": target, "source_ids": sources, "target_ids": targets, "confidence": confidence}


def judgment_relations(elements: list[dict], refs: list[dict], citations: list[dict], disposition: dict | None, opinions: list[dict]) -> list[dict]:
    by_role: dict[str, list[str]] = {}
    for e in elements:
        if e["type"] in ("PARA", "SUBPARA") and not e["is_empty"]:
            by_role.setdefault(e["section_role"] or "unclassified", []).append(e["id"])
    pairs = (("issues", "reasoning", "issue-reasoning-link"), ("reasoning", "disposition", "reasoning-disposition-link"), ("facts", "reasoning", "facts-reasoning-link"))
    out = [_relation(name, sources=by_role[a], targets=by_role[b], confidence="structural") for a, b, name in pairs if a in by_role and b in by_role]
    out += [_relation("internal-reference", r["source_id"], r["target_id"]) for r in refs]
    out += [_relation("citation-link", c["owner_id"]) for c in citations]
    if disposition:
        out.append(_relation("document-disposition", disposition["id"] if disposition["detail"] and disposition["id"] != "DISPOSITION" else None, "JUDGMENT_OUTCOME"))
    return out + [_relation("separate-opinion-marker", (owner(elements, o["position"]) or {}).get("id")) for o in opinions]


# --- metadata ---


def _fields(text: str, table: list) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, lines, patterns, template in table:
        scope = "\n".join(text.split("\n", lines)[:lines]) if lines else text
        m = next((m for m in (form(p).search(scope) for p in patterns) if m), None)
        if m and name not in out:
            out[name] = _sentence(m[1]) if template == "sentence" else m[1].strip() if template == "{1}" else m[0] if template == "{0}" else template.format(m[0], *m.groups()[:1])
    return out


def find_title(text: str, kind: str) -> str | None:
    lines, least, most, capitals, words, none, upper = forms.TITLES[kind]
    for line in (x.strip() for x in text.split("\n", lines)[:lines]):
        if least <= len(line) <= most and not (none and form(none).search(line)):
            share = _capitals(line)
            if capitals is not None and share is not None and share > capitals or words and form(words).search(line) and (share is not None or kind == "constitution") or upper and line == line.upper():
                return line
    return None


def known_constitution(text: str) -> tuple | None:
    """A constitution known by its own words, in the first 24,000 characters (a feature: later mentions are citations)."""
    head = text[:24_000]
    has = lambda p: bool(form(p).search(head))
    opens = has(r"\bWe\s+the\s+People\s+of\s+the\s+United\s+States\b") or has(r"\bsecure\s+the\s+Blessings\s+of\s+Liberty\b") and has(r"\bordain\s+and\s+establish\s+this\s+Constitution\s+for\s+the\s+United\b")
    if opens and has(r"\bConstitution\b") and has(r"\bUnited\s+States\b") and any(all(has(rf"\b{w}\s+{n}\b") for n in ("I", "II", "III")) for w in ("Article", "Amendment")):
        return forms.US_CONSTITUTION
    return forms.FR_CONSTITUTION if has(r"\bConstitution\s+du\s+4\s+octobre\s+1958\b") else None


def case_number(head: str) -> str | None:
    m = next((m for m in (form(p, p != forms.CASE_NUMBERS[5]).search(head) for p in forms.CASE_NUMBERS) if m), None)
    if not m:
        return None
    found = next((g for g in m.groups() if g), None) or m[0]
    return " ".join(re.sub(r"^(?:pourvoi\s+)?n[°º]\s*", "", found, flags=re.I).split())


def find_parties(text: str, kind: str, language: str) -> list[str]:
    """Parties of a contract (two or more), or applicant and respondent of a judgment; sought in the first 5000 characters."""
    head = text[:5000]
    clean = lambda p: " ".join((p or "").split()).removesuffix(",").strip()
    if kind == "contract":
        for p in forms.CONTRACT_PARTIES[language]:
            m = re.search(p, head, re.I | re.M | re.A)
            found = [x for x in map(clean, m.groups()) if x] if m else []
            if len(found) >= 2:
                return found
        return []
    if kind != "judgment":
        return []
    between, sides_of = forms.JUDGMENT_PARTIES.get(language, forms.JUDGMENT_PARTIES["en"])
    # Only a text with a separator before a name that ends a line can hold the form, which is slow to fail.
    m = form(sides_of).search(head) if form(between).search(head) else None
    sides = list(m.groups()) if m else [x and x[1] for x in (form(p).search(head) for p in forms.PARTY_LINES)]
    if language == "fr":
        own = form(r"Attendu\s+que\s+(.{2,100}?)\s+fait\s+grief\b").search(text), form(r"d[ée]cision\s+de\s+la\s+(.{3,140}?)\s+ayant\s+refus[ée](?=\s|[,.])").search(text)
        sides = [o[1] if o else s for o, s in zip(own, sides)]
    return [clean(s) for s in sides] if any(sides) else []


def find_metadata(text: str, kind: str, language: str, filename: str | None, blocks: dict[str, dict], parties: list[str]) -> dict[str, str]:
    """The fields of a type that the text names, with title and language."""
    meta = _fields(text, forms.FIELDS[kind])
    named = title_of_file(filename)
    if kind == "constitution" and (known := known_constitution(text)):
        meta = dict(zip(("title", "short_title", "jurisdiction", "authority", "adoption_date", "date_force", "reference"), known)) | {"status": "In force, as amended"}
    elif kind == "judgment":
        if language == "fr":
            meta |= _fields(text, forms.FRENCH_FIELDS)
            sample = (form(r"valeur\s+constitutionnelle|article\s+77\s+de\s+la\s+Constitution").search(text), form(r"engagements?\s+internationaux|Pacte\s+international|Convention\s+europ[ée]enne").search(text))
            field = {(True, True): "Constitutional and international law", (True, False): "Constitutional law", (False, True): "International law"}.get(tuple(map(bool, sample)))
            meta |= {"field": field} if field else {}
        court = " ".join(meta["court"].split()) if "court" in meta else None
        if court and court.lower() == "cour de cassation":
            court = "Cour de cassation"
        case = case_number(text[:5000]) if "header" in blocks else None
        case = case or case_number("\n".join(text.split("\n", 45)[:45]))
        if court:
            meta |= {"court": court, "authority": court} | ({"jurisdiction": "France"} if "cour de cassation" in court.lower() else {})
        if case:
            meta |= {"case_number": case, "reference": case}
        if court and case:
            shown = f"pourvoi n° {case}" if re.fullmatch(r"\d{2,4}-\d{2}\.\d{3}", case) else case
            title = " - ".join(x for x in (court, meta.get("formation"), meta.get("judgment_date"), shown) if x)
        else:
            title = f"{parties[0]} v {parties[1]}" if len(parties) == 2 and all(parties) else court or named or forms.UNTITLED[kind]
        meta |= {"title": title, "short_title": f"{court} {case}" if court and case else title}
        if "judgment_date" in meta:
            meta["adoption_date"] = meta["judgment_date"]
    else:
        line = find_title(text, kind)
        number_ = meta.get("regulation_number") or meta.get("directive_number")
        title = meta.get("short_title") or named or line if kind == "statute" else line or named
        meta["title"] = title or number_ or meta.get("contract_type") or forms.UNTITLED[kind]
        if kind == "treaty":
            closing = blocks["closing"]["content"] if "closing" in blocks else text
            m = form(r"\bDone\s+at\s+([^,.\n]+),?\s+(?:on\s+)?(\d{1,2}\s+\w+\s+\d{4}|\d{4})\b").search(closing)
            if m:
                meta |= {"signature_place": m[1].strip(), "signature_date": m[2].strip()}
            elif d := form(forms.DATE_EN).search(text):
                meta["signature_date"] = d[0]
            if "signature_date" in meta:
                meta["adoption_date"] = meta["signature_date"]
            spoken = form(r"\b(?:English|French|Spanish|Arabic|Chinese|Russian|German)\b(?:,\s*(?:English|French|Spanish|Arabic|Chinese|Russian|German)\b)*").search(closing)
            if spoken:
                meta["authentic_languages"] = ", ".join(_first(re.split(r"\s*,\s*", spoken[0]), str.lower))
        if kind == "directive":
            m = form(r"\b(?:by|before|no\s+later\s+than|from)\s+(\d{1,2}\s+\w+\s+\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b").search(text)
            if m and re.search("transpos|Member States shall|adopt and publish", context(text, m.start(), m[0], 140), re.I):
                meta["transposition_deadline"] = m[1]
        if kind == "unknown":
            head = "\n".join(text.split("\n", 25)[:25])
            guesses = ((r"\b(?:Article|ARTICLE)\s+\d{1,4}\b", "Structured legal document (articles detected)"), (r"\b(?:Section|SECTION)\s+\d+\b", "Structured legal document (sections detected)"), (r"\b(?:Clause|CLAUSE)\s+\d+\b", "Structured legal document (clauses detected)"), (r"\b(?:WHEREAS|BETWEEN)\b", "Possible contract or agreement"))
            meta["best_guess"] = next((g for p, g in guesses if form(p, False).search(head)), "Unknown legal document")
    return {k: v for k, v in meta.items() if v}


def cite(e: dict, meta: dict[str, str], kind: str) -> str:
    """Citation of an element of a document."""
    title = meta.get("short_title") or meta.get("title") or "Untitled Document"
    ref = next((meta[k] for k in ("regulation_number", "directive_number", "case_number", "act_number") if k in meta), title)
    n = e.get("identifier") or ""
    own = {("judgment", "PARA"): f"[{n}], {ref}", ("statute", "SEC"): f"Section {n}, {title}", ("contract", "CL"): f"Clause {n}, {title}"}.get((kind, e["type"]))
    if own:
        return own
    label = {"RECITALS": "Recitals", "ART": f"Article {n}"}.get(e["type"])
    return f"{label or (f'{e["type"]} {n}' if n and e['type'] not in ('PREAMBLE', 'HEADER') else e['heading'] or e['type'])}, {ref}"


# Fields of judgments whose first place in the text is reported.
PROVENANCE = ("court", "formation", "case_number", "judgment_date", "publication_status", "reporter_citation", "outcome", "lower_court")


# --- one document ---


def _signals(text: str, kind: str, language: str, elements: list[dict]) -> list[dict]:
    """Opinions, transposition, commencement, boilerplate, claims, authorities: (kind, detail, element, heading, position)."""
    out = []
    add = lambda k, d, e, h, p: out.append({"kind": k, "detail": d, "id": e, "heading": h, "position": p})
    if kind == "judgment":
        for p, name in forms.OPINIONS.get(language, forms.OPINIONS["en"]):
            for m in form(p).finditer(text):
                add("separate-opinion", name, None, m[0], m.start())
        if language == "fr":
            marker = form(r"alors,\s+selon\s+le\s+moyen\s*:").search(text)
            if marker:
                end = form(r"\n\s*(?:Mais\s+attendu|Attendu,?\s+ensuite|D['’]où\s+il\s+suit|PAR\s+CES\s+MOTIFS)").search(text, marker.end())
                stop = end.start() if end else len(text)
                for m in re.finditer(r"(\d+)°\s+((?:(?!\s*;\s*\d+°)[\s\S])*)", text[marker.end() : stop], re.A):
                    add("claim", tidy(m[2]).removesuffix(";").strip(), f"CLAIM-{m[1]}", f"{m[1]}°", marker.end() + m.start())
                facts = form(r"Attendu\s+que\s+((?:(?!Attendu\s+que)[\s\S])*?)\s*,?\s*alors,\s+selon\s+le\s+moyen\s*:").search(text)
                if facts:
                    add("facts", f"Attendu que {tidy(facts[1])}", None, "Attendu que", facts.start())
            found = [(n, m) for n, p in forms.AUTHORITIES for m in form(p).finditer(text)]
            for n, m in _first(found, lambda x: (x[0], x[1][0].lower())):
                add("authority", n, None, m[0], m.start())
    for e in elements:
        both = f"{e['heading']}\n{e['content']}"
        if kind == "directive" and e["type"] == "ART" and e["content"] and not e["is_empty"]:
            hits = sum(bool(form(p).search(e["content"])) for p in forms.TRANSPOSITION[language])
            if hits:
                add("transposition", str(hits), e["id"], e["heading"], e["position"])
        elif kind == "statute" and form(forms.COMMENCEMENT).search(both):
            add("commencement", preview(e["content"] or context(text, e["position"], e["heading"], 180), 260), e["id"], e["heading"], e["position"])
        elif kind == "contract" and e["content"] and not e["is_empty"]:
            for name, by_language in forms.BOILERPLATE.items():
                if any(form(p).search(both) for p in by_language[language]):
                    add("boilerplate", name, e["id"], e["heading"], e["position"])
    return out


def _amendments(text: str, kind: str, language: str, elements: list[dict]) -> list[dict]:
    row = lambda i, c, h, p, by: {"id": i, "canonical_id": c, "heading": h, "position": p, "found_by": by}
    if kind == "statute":
        return [row(e["id"], e["id"], e["heading"], e["position"], "keyword") for e in elements if form(forms.STATUTE_AMENDS).search(f"{e['heading']}\n{e['content']}")]
    if kind != "constitution":
        return []
    out = [row(e["id"], e["id"], e["heading"], e["position"], "structure") for e in elements if e["is_amendment"]]
    at = 0
    for line in text.split("\n"):
        bare = line.strip()
        if any(w in bare.lower() for w in forms.AMENDMENT_WORDS[language]) and looks_like_heading(bare) and not any(abs(a["position"] - at) < 120 for a in out):
            out.append(row(f"AMENDMENT-{len(out) + 1:04d}", None, bare, at, "keyword"))
        at += len(line) + 1
    return out


def _paragraph_blocks(text: str) -> list[dict]:
    """Blocks of a document without any structure."""
    out, at = [], 0
    for block in re.split(r"\n\n+", text):
        if block.strip():
            at = max(text.find(block, at), at)
            n = f"{len(out) + 1:04d}"
            e = _element("BLOCK", 9, str(len(out) + 1), n, f"BLOCK-{n}", at, len(out), first_line(tidy(block), 180) or f"Block {len(out) + 1}", end_position=at + len(block))
            _set_content(e, tidy(block), 20)
            out.append(e)
            at += len(block)
    return out


def parse(raw: str | None, kind: str, language: str | None, filename: str | None = None) -> dict:
    """Everything one document says about itself; ``kind`` is one of the eight types and other languages count as English.

    A null or too short text (50 characters, 20 for the unknown type) gives status 'empty' and no elements; a type's parser that finds no
    structure gives 'no-structure' (the unknown type falls back to blocks).
    """
    kind = kind if kind in forms.HEADINGS else "unknown"
    language = language if language in LANGUAGES else "en"
    text = tidy(raw or "")
    warnings: list[str] = ["GENERIC_PARSER_USED"] if kind == "unknown" else []
    out = {"kind": kind, "language": language, "status": "empty", "title": forms.UNTITLED[kind], "metadata": {}, "parties": [], "warnings": warnings, "summary": None, "document_citation": None, "core_units": 0}
    out |= {k: [] for k in ("elements", "blocks", "refs", "citations", "relations", "amendments", "signals")}
    if len(text) < (20 if kind == "unknown" else 50):
        warnings.append("EMPTY_TEXT")
        return out
    blocks = {b["key"]: b for b in front_and_end(text, kind, language)}
    stop = next((blocks[k]["position"] for k in ("signatures", "closing") if k in blocks), None)
    elements = discover(text, kind, language, blocks["preamble"]["end_position"] if kind == "statute" and "preamble" in blocks else 0, stop)
    if not elements:
        warnings.append("NO_STRUCTURE")
        out["status"] = "no-structure"
        if kind == "unknown":
            elements = _paragraph_blocks(text)
    else:
        out["status"] = "parsed"
        set_extents(text, elements, 5 if kind == "judgment" else 20)
    if kind == "constitution" and elements:
        inline = _inline_sections(text, elements, language)
        if inline:
            elements = _near_duplicates(sorted(elements + inline, key=lambda e: e["position"]))
            set_extents(text, elements)
        current = None
        for e in elements:
            if e["type"] == "ART":
                current = e
            elif e["type"] == "SEC" and current:
                e["id"], e["sort_key"] = f"{current['id']}-SEC-{e['normalized']}", f"{current['sort_key']}-SEC-{e['normalized']}"
                e["parent_id"], e["parent_role"] = current["id"], "article"
        preamble = _constitution_preamble(text, elements, language)
        if preamble:
            blocks["preamble"] = preamble
    elif kind in ("regulation", "directive"):
        elements = _article_paragraphs(elements)
    elif kind == "judgment":
        elements = _judged(elements)
    parties = find_parties(text, kind, language)
    if kind == "treaty":
        scope = blocks["preamble"]["content"] if "preamble" in blocks else "\n".join(text.split("\n", 30)[:30])
        parties = _first(form(r"\b(?:States|Parties|Contracting Parties|High Contracting Parties|European Union|United Nations)\b").findall(scope), str.lower)[:12]
    meta = find_metadata(text, kind, language, filename, blocks, parties)
    if kind == "judgment" and (d := _disposition(text, elements, language)):
        blocks["disposition"] = d
    set_tree(elements)
    sources = [{"id": b["id"], "type": b["type"], "level": -1, "position": b["position"], "end_position": b["end_position"], "content": b["content"], "is_empty": len(b["content"]) < 20} for k, b in blocks.items() if k != "disposition"]
    refs = cross_references(sources + elements, kind, language) if elements else []
    signals = _signals(text, kind, language, elements)
    if kind == "judgment":
        low = text.lower()
        signals += [{"kind": "provenance", "detail": meta[f], "id": None, "heading": f, "position": max(low.find(meta[f].lower()), 0)} for f in PROVENANCE if f in meta]
    citations = judgment_citations(text, elements) if kind == "judgment" and elements else []
    opinions = [s for s in signals if s["kind"] == "separate-opinion"]
    units, least, code = forms.CORE_UNITS[kind]
    core = [e for e in elements if not e["is_empty"] and (kind == "judgment" or units is None or e["type"] in units)]
    if out["status"] == "parsed":
        if len(core) < least:
            warnings.append(code)
        checks = (
            ("WEAK_CASE_METADATA", kind == "judgment" and not {"court", "case_number"} & meta.keys()), ("NO_DISPOSITION_DETECTED", kind == "judgment" and "disposition" not in blocks),
            ("NO_TRANSPOSITION_SIGNAL", kind == "directive" and not signals), ("NO_PARTIES_DETECTED", kind == "contract" and not parties),
        )
        warnings += [c for c, bad in checks if bad]
    for e in (*elements, *blocks.values()):
        e["citation"] = cite(e, meta, kind)
    _count_references(elements, refs, units)
    relations = judgment_relations(elements, refs, citations, blocks.get("disposition"), opinions) if kind == "judgment" and elements else []
    amendments = _amendments(text, kind, language, elements)
    cited = [meta.get(k) for k in ("title", "regulation_number", "directive_number", "case_number", "act_number", "jurisdiction")] + [meta.get("adoption_date") or meta.get("signature_date")]
    counts = ((len(refs), "cross-reference(s) detected."), (len(citations), "citation(s) detected."), (len(relations), "relationship signal(s) detected."), (len(amendments), "amendment signal(s) detected."), (len(warnings), "warning(s) require review."))
    provisions = [e for e in elements if e["chosen"] and not e["is_empty"]]
    parts = [f"{TYPE_LABELS[kind]} parsed into {len(provisions)} provision node(s).", f"Title: {meta['title']}."] + ([f"Jurisdiction: {meta['jurisdiction']}."] if "jurisdiction" in meta else []) + [f"{n} {what}" for n, what in counts if n]
    return out | {
        "title": meta["title"], "metadata": meta, "parties": parties, "summary": " ".join(parts), "document_citation": ", ".join(x for x in cited if x), "core_units": len(core), "elements": elements, "blocks": list(blocks.values()),
        "refs": refs, "citations": citations, "relations": relations, "amendments": amendments, "signals": signals,
    }


def _judged(elements: list[dict]) -> list[dict]:
    """Judgments: text beside a number belongs to its paragraph, paragraphs link back to their section, markers of prose blocks stay with their text."""
    section = None
    for e in elements:
        if e["inline"]:
            _set_content(e, f"{e['inline']}\n{e['content']}".strip(), 5)
        if e["type"] == "SECT":
            section = e
        elif e["type"] in ("PARA", "SUBPARA") and section:
            e["section_id"], e["section_role"] = section["id"], section["role"]
        elif e["type"] in ("ISSUE", "CLAIMS", "REASONING", "CONCLUSION", "DISPOSITION", "ORDER"):
            _set_content(e, f"{e['heading']} {e['content']}".strip(), 5)
            e["heading"] = e["title"] or e["heading"]
    return [e for e in elements if e["type"] != "SOURCE_ANALYSIS"]


_NAMES = [c.split()[0] for c in ELEMENT.split(", ")]
_COLUMNS = ["kind", "language", "status", "title", "metadata", "parties", "warnings", "summary", "document_citation", "core_units", "elements", "blocks", "refs", "citations", "relations", "amendments", "signals"]


def parse_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "kind", language: str = "lang", filename: str | None = None, content: bool = True) -> DataFrame:
    """key and the columns of ``PARSED``, one row a document, in one pass over the text without a shuffle.

    Without ``content`` elements and blocks come without their text (and contexts), so that queries over structure carry none of it.
    Repeated rows are parsed as often as they come; an empty table gives no rows.
    """
    picked = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(kind).alias("_kind"), F.col(language).alias("_lang"), (F.col(filename) if filename else F.lit(None).cast("string")).alias("_file"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for k, t, kd, lg, fn in pdf.itertuples(index=False, name=None):
                p = parse(t, kd, lg, fn)
                p["elements"] = [{n: e.get(n) for n in _NAMES} for e in p["elements"]]
                if not content:
                    for x in (*p["elements"], *p["blocks"]):
                        x["content"] = None
                    for x in (*p["refs"], *p["citations"]):
                        x["context"] = None
                yield k, *[p[c] for c in _COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        for row in rows(batches):
            block.append(row)
            if len(block) >= BATCH:
                yield pd.DataFrame(block, columns=["_k", *_COLUMNS])
                block = []
        if block:
            yield pd.DataFrame(block, columns=["_k", *_COLUMNS])

    return picked.mapInPandas(run, f"_k {docs.schema[key].dataType.simpleString()}, {PARSED}").withColumnRenamed("_k", key)
