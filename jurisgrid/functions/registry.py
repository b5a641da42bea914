"""Markers, signals, keywords, levels, dictionaries and codes that results depend on."""

from __future__ import annotations

# Marker strings of the language detector.
LANGUAGE_MARKERS = {
    "en": [" the ", " of ", " and ", " shall ", " this ", " with ", " which ", " rights ", " article "],
    "fr": [" le ", " la ", " les ", " des ", " est ", " une ", " dans ", " pour ", " avec ", " article "],
    "de": [" der ", " die ", " das ", " und ", " ist ", " von ", " mit ", " für ", " nicht ", " artikel "],
    "es": [" el ", " la ", " los ", " las ", " del ", " una ", " que ", " por ", " con ", " artículo "],
}
TYPES = ["constitution", "regulation", "directive", "treaty", "statute", "judgment", "contract", "unknown"]
# Type -> label, origin, documentFamily, authorityClass, bindingCharacter.
DIMENSIONS = {
    "constitution": ("Constitution", "legislative", "foundational-instrument", "primary", "binding"),
    "regulation": ("EU Regulation", "administrative", "regulatory-instrument", "primary", "binding"),
    "directive": ("EU Directive", "legislative", "regulatory-instrument", "primary", "binding"),
    "treaty": ("Treaty", "international", "international-instrument", "primary", "binding"),
    "statute": ("Statute / Act", "legislative", "legislative-act", "primary", "binding"),
    "judgment": ("Judgment", "judicial", "judicial-decision", "primary", "undetermined"),
    "contract": ("Contract / Agreement", "private", "private-instrument", "private", "enforceable-inter-partes"),
    "unknown": ("Unknown Document", None, "unclassified", "undetermined", "undetermined"),
}
# Labels of types in fiches and identities.
TYPE_LABELS = {
    "constitution": "Constitution", "regulation": "EU Regulation", "directive": "EU Directive", "treaty": "Treaty", "statute": "Statute / Act", "judgment": "Judgment / Decision", "contract": "Contract / Agreement", "unknown": "Legal Document",
}
# Registered values of the four dimensions.
CLASSIFICATION_VALUES = {
    "origin": ("judicial", "legislative", "administrative", "academic", "private", "international"),
    "document_family": ("judicial-decision", "regulatory-instrument", "foundational-instrument", "legislative-act", "international-instrument", "private-instrument", "scholarship", "preparatory-material", "unclassified"),
    "authority_class": ("primary", "secondary", "preparatory", "non-binding-institutional", "private", "undetermined"),
    "binding_character": ("binding", "persuasive", "non-binding", "enforceable-inter-partes", "undetermined"),
}
# Fixed values: (type, signal, weight, zone, least matches, patterns); zones are early, body, late, anywhere.
SIGNALS = [
    ("constitution", "us_constitution_preamble", 55, "early", 1, [r"\bWe\s+the\s+People\s+of\s+the\s+United\s+States\b"]),
    ("constitution", "us_constitution_preamble_tail", 46, "early", 1, [r"\bsecure\s+the\s+Blessings\s+of\s+Liberty\b[\s\S]{0,260}\bordain\s+and\s+establish\s+this\s+Constitution\s+for\s+the\s+United"]),
    ("constitution", "named_constitution_en", 48, "early", 1, [r"\bConstitution\s+of\s+(?:the\s+)?[A-Z][A-Za-z .'-]{2,80}\b"]),
    ("constitution", "french_constitution_exact", 55, "early", 1, [r"\bConstitution\s+du\s+4\s+octobre\s+1958\b"]),
    ("constitution", "french_constitution_title", 44, "early", 1, [r"\bConstitution\s+(?:de\s+la\s+République\s+française|française)\b"]),
    ("constitution", "grundgesetz_exact", 52, "early", 1, [r"\bGrundgesetz\s+(?:für\s+die\s+Bundesrepublik\s+Deutschland|vom\s+23\.\s+Mai\s+1949)\b"]),
    ("constitution", "spanish_constitution_exact", 50, "early", 1, [r"\bConstitución\s+Española\s+(?:de\s+1978|del\s+27\s+de\s+diciembre)\b"]),
    ("constitution", "sovereignty_language", 22, "early", 1, [r"\bsovereign(?:ty)?\s+(?:of\s+the\s+)?(?:people|nation|state)\b", r"\bsouveraineté\s+(?:nationale|du\s+peuple)\b", r"\bStaatsgewalt\s+(?:geht\s+)?vom\s+Volke\b", r"\bsoberanía\s+(?:nacional|del\s+pueblo)\b"]),
    ("constitution", "fundamental_rights", 18, "anywhere", 1, [r"\bfundamental\s+(?:rights?|freedoms?|liberties)\b", r"\bdroits?\s+fondamentaux\b", r"\bGrundrechte\b", r"\bderechos?\s+fundamentales\b"]),
    ("constitution", "article_numbering_constitution", 10, "body", 5, [r"\bArticle\s+\d{1,3}(?:er)?\b", r"\bArticle\s+[IVXLCDM]{1,8}\b", r"\bArtikel\s+\d{1,3}\b", r"\bArtículo\s+\d{1,3}\b"]),
    ("constitution", "us_constitution_amendments", 18, "body", 5, [r"\bAmendment\s+[IVXLCDM]{1,8}\b"]),
    ("constitution", "anti_eu_regulation", -42, "anywhere", 1, [r"\bRegulation\s+\(EU\)\s+\d{4}/\d{1,4}\b", r"\bRèglement\s+\(UE\)\s+\d{4}/\d{1,4}\b"]),
    ("constitution", "anti_contract_recital", -35, "anywhere", 1, [r"\b(?:WHEREAS|NOW\s+THEREFORE|IN\s+WITNESS\s+WHEREOF)\b"]),
    ("regulation", "eu_regulation_reference", 58, "early", 1, [r"\bRegulation\s+\(EU\)\s+\d{4}/\d{1,4}\b", r"\bRèglement\s+\(UE\)\s+\d{4}/\d{1,4}\b"]),
    ("regulation", "eu_regulation_no_reference", 48, "early", 1, [r"\bRegulation\s+\(EU\)\s+No\.?\s+\d{1,4}/\d{4}\b"]),
    ("regulation", "eu_legislative_bodies", 26, "early", 1, [r"\bEuropean\s+Parliament\s+and\s+(?:of\s+)?the\s+Council\b", r"\bParlement\s+européen\s+et\s+(?:du\s+)?Conseil\b"]),
    ("regulation", "direct_applicability", 34, "late", 1, [r"\bbinding\s+in\s+its\s+entirety\s+and\s+directly\s+applicable\b"]),
    ("regulation", "official_journal", 14, "early", 1, [r"\bOfficial\s+Journal\s+of\s+the\s+European\s+Union\b", r"\bJournal\s+officiel\s+de\s+l'Union\s+européenne\b"]),
    ("regulation", "whereas_recitals", 12, "early", 1, [r"\bWhereas\s*:?", r"\bconsidérant\s+ce\s+qui\s+suit\b"]),
    ("regulation", "article_numbering_regulation", 10, "body", 5, [r"\bArticle\s+\d{1,3}\b"]),
    ("regulation", "anti_directive_transposition", -34, "anywhere", 1, [r"\b(?:transpos(?:e|ing|ition|ed)|Member\s+States\s+shall\s+bring\s+into\s+force)\b"]),
    ("directive", "eu_directive_reference", 58, "early", 1, [r"\bDirective\s+\(EU\)\s+\d{4}/\d{1,4}\b", r"\bDirective\s+\d{4}/\d{1,4}/EU\b", r"\bDirective\s+\d{4}/\d{1,4}/UE\b"]),
    ("directive", "member_states_shall", 28, "body", 1, [r"\bMember\s+States\s+shall\b"]),
    ("directive", "transposition_language", 30, "anywhere", 1, [r"\b(?:transpos(?:e|ing|ition|ed)|bring\s+into\s+force\s+the\s+laws,\s+regulations\s+and\s+administrative\s+provisions)\b"]),
    ("directive", "eu_legislative_bodies_directive", 22, "early", 1, [r"\bEuropean\s+Parliament\s+and\s+(?:of\s+)?the\s+Council\b"]),
    ("directive", "article_numbering_directive", 8, "body", 5, [r"\bArticle\s+\d{1,3}\b"]),
    ("directive", "anti_regulation_reference", -42, "anywhere", 1, [r"\bRegulation\s+\(EU\)\s+\d{4}/\d{1,4}\b"]),
    ("treaty", "named_treaty", 52, "early", 1, [r"\bTreaty\s+(?:on|of)\s+(?:the\s+)?[A-Z][A-Za-z .'-]{3,90}\b"]),
    ("treaty", "vclt_reference", 48, "anywhere", 1, [r"\bVienna\s+Convention\s+on\s+the\s+Law\s+of\s+Treaties\b"]),
    ("treaty", "contracting_parties", 28, "anywhere", 1, [r"\bcontracting\s+(?:parties|states?|governments?)\b"]),
    ("treaty", "ratification_accession", 22, "anywhere", 1, [r"\b(?:ratify|ratification|accede|accession|depositary)\b"]),
    ("treaty", "treaty_closing_formula", 24, "late", 1, [r"\bin\s+witness\s+whereof\b"]),
    ("statute", "enactment_clause", 50, "early", 1, [r"\bBe\s+it\s+enacted\s+by\b"]),
    ("statute", "public_law_number", 48, "early", 1, [r"\bPublic\s+Law\s+\d{2,3}[-–]\d{1,4}\b"]),
    ("statute", "act_title_formula", 26, "early", 1, [r"\bAn\s+Act\s+(?:to|for|relating\s+to|concerning|amending)\b"]),
    ("statute", "statutory_structure", 14, "body", 5, [r"\b(?:section|subsection|paragraph|subparagraph|clause)\s+\d+[A-Z]?\b"]),
    ("statute", "amend_repeal_language", 12, "body", 1, [r"\b(?:repeal|amend|insert|substitute)\w*\s+(?:the\s+)?(?:Act|section|subsection)\b"]),
    ("judgment", "ecj_case_reference", 50, "early", 1, [r"\b(?:Case\s+)?C-\d+/\d+\b"]),
    ("judgment", "uk_neutral_citation", 48, "early", 1, [r"\b\[?\d{4}\]?\s+(?:UKSC|UKHL|UKPC|EWCA|EWHC)\s+\d+\b"]),
    ("judgment", "us_case_citation", 42, "early", 1, [r"\b\d+\s+(?:F\.\s*)?(?:Supp\.|F\.|U\.S\.)\s*\d+\b"]),
    ("judgment", "french_court_name", 46, "early", 1, [
        r"\b(?:Cour\s+d'appel|Cour\s+de\s+cassation|Conseil\s+d['’]Etat|Conseil\s+constitutionnel|Cour\s+administrative\s+d'appel)\b",
        r"\b(?:Tribunal\s+judiciaire|Tribunal\s+administratif|Tribunal\s+de\s+commerce|Tribunal\s+correctionnel|Tribunal\s+de\s+police)\b",
        r"\b(?:Conseil\s+de\s+prud['’]?hommes|Conseil\s+des\s+prud['’]?hommes)\b"]),
    ("judgment", "french_decision_heading", 42, "early", 1, [
        r"\b(?:ARR[ÊE]T|JUGEMENT|ORDONNANCE|D[ÉE]CISION)\s+(?:DU|DU\s+\d{1,2}|DE\s+LA|DE\s+L['’])?",
        r"\b(?:JUGEMENT\s+CONTRADICTOIRE|JUGEMENT\s+R[ÉE]PUT[ÉE]\s+CONTRADICTOIRE|ORDONNANCE\s+DE\s+R[ÉE]F[ÉE]R[ÉE])\b"]),
    ("judgment", "french_case_number", 24, "early", 1, [
        r"\b(?:N[°º]\s*RG|RG\s*n[°º]?|N[°º]\s*Portalis|DTA)\s*[:\-]?\s*[A-Z0-9/\-. ]{4,}\b",
        r"\b(?:R[ée]pertoire\s+g[ée]n[ée]ral|Minute\s+n[°º]?|Dossier\s+n[°º]?)\s*[:\-]?\s*[A-Z0-9/\-. ]{4,}\b"]),
    ("judgment", "french_reasons_disposition", 28, "anywhere", 1, [
        r"\b(?:MOTIFS\s+DE\s+LA\s+D[ÉE]CISION|PAR\s+CES\s+MOTIFS|FAITS\s+ET\s+PROC[ÉE]DURE)\b",
        r"\b(?:EXPOS[ÉE]\s+DU\s+LITIGE|RAPPEL\s+DES\s+FAITS|SUR\s+CE[, ]|DISCUSSION|MOTIVATION)\b"]),
    ("judgment", "party_roles", 20, "anywhere", 2, [r"\b(?:plaintiff|defendant|appellant|respondent|applicant|claimant|petitioner)\b"]),
    ("judgment", "court_reasoning_language", 24, "body", 1, [r"\b(?:the\s+)?(?:court|tribunal|chamber)\s+(?:held|found|ruled|concluded|determined|considered|observed)\b"]),
    ("contract", "contract_recital", 45, "early", 1, [r"\b(?:WHEREAS|WITNESSETH|NOW\s+THEREFORE)\b"]),
    ("contract", "contract_execution", 45, "late", 1, [r"\bIN\s+WITNESS\s+WHEREOF\b"]),
    ("contract", "party_structure", 28, "anywhere", 1, [r"\b(?:Party|Parties)\s+(?:of|to)\s+(?:the|this)\s+(?:First|Second|Third|Fourth|Agreement)\b"]),
    ("contract", "boilerplate_terms", 22, "anywhere", 3, [r"\b(?:hereinafter|hereto|herein|hereby|hereunder|hereof|thereto|therein|thereby|thereunder|thereof)\b"]),
    ("contract", "contract_clauses", 18, "body", 1, [r"\b(?:governing\s+law|jurisdiction|arbitration|force\s+majeure|confidentiality|severability|entire\s+agreement)\b"]),
    ("contract", "anti_legislation_articles", -28, "body", 10, [r"\bArticle\s+\d{1,3}\b"]),
]
# File name hints in order of preference.
FILENAME_HINTS = [("constitution", "constitution"), ("regulation", "regulation"), ("directive", "directive"), ("treaty", "treaty"), ("agreement", "contract"), ("contract", "contract"), ("judgment", "judgment"), ("decision", "judgment"), ("act", "statute"), ("statute", "statute")]
FILENAME_WEIGHT = 8

# Roles of section headings, first match wins.
SECTION_ROLES = [
    ("facts", "fact|background|procedural|history|faits|contexte|sachverhalt|hechos|antecedentes"), ("legal-context", r"legal\s+context|law|droit|recht"), ("issues", "issue|question|moyen"),
    ("reasoning", "reason|analysis|discussion|finding|motif|gründe|gruende|fundamento|considerando"), ("disposition", "conclusion|disposition|holding|order|costs|dispositif|dépens|depens|tenor|fallo|costas"),
]
# Concepts of the concept index.
CONCEPTS = {
    "en": [
        "jurisdiction", "liability", "obligation", "compliance", "enforcement", "penalty", "remedy", "appeal", "review", "amendment", "derogation", "exemption", "authorisation", "authorization", "notification", "registration", "transparency", "proportionality", "subsidiarity", "accountability",
        "termination", "confidentiality", "damages",
    ],
    "fr": ["juridiction", "responsabilite", "responsabilité", "obligation", "conformite", "conformité", "sanction", "recours", "appel", "revision", "révision", "modification", "derogation", "dérogation", "transparence", "proportionnalite", "proportionnalité"],
}
