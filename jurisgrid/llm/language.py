"""Language of documents and of the segments of mixed-language text.

The script ranges of a word's letters narrow its candidate languages: letters that only some of the four use leave those, a word
without Latin letters is no evidence for any. Words get log-likelihood scores from a model that is trained here, and Viterbi with a
switching penalty labels spans, also within a block; a batch of texts runs through Viterbi together in numpy. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jurisgrid.llm.skeleton import skeleton
from jurisgrid.llm.words import FUNCTION_WORDS

LANGUAGES = ("en", "fr", "de", "es")
# Spellings of the languages' labels (before region suffixes are cut).
LABELS = {
    "en": "en eng english englisch anglais inglés ingles", "fr": "fr fra fre french français francais französisch francés frances",
    "de": "de deu ger german deutsch allemand alemán aleman", "es": "es spa spanish español espanol castellano espagnol spanisch",
}
_CODE = {s: lang for lang, names in LABELS.items() for s in names.split()}
_WORD = re.compile(r"[^\W\d_]+")
_BLOCK = re.compile(r"\n[^\S\n]*\n\s*")
_LATIN = re.compile(r"[a-zà-öø-ÿœ]")
# Ranges of letters beyond a to z and the languages that write them; other letters belong to none of the four.
SCRIPTS = [("a-z", "en fr de es"), ("äöß", "de"), ("ü", "de es fr"), ("ñáíóú", "es"), ("é", "fr es en"), ("àâçèêëîïôùûÿœæ", "fr")]
_SCRIPTS = [(re.compile(f"[{letters}]"), frozenset(langs.split())) for letters, langs in SCRIPTS]


def candidates(word: str) -> frozenset[str]:
    """Languages whose script ranges hold all letters of a lower-case word."""
    rest, out = word, frozenset(LANGUAGES)
    for pattern, langs in _SCRIPTS:
        if pattern.search(rest):
            rest, out = pattern.sub("", rest), out & langs
    return out if not rest else frozenset()


def label_language(label: str | None) -> str | None:
    """Language code that a label names, in whatever spelling; None for placeholders and other languages."""
    key = re.split(r"[-_;,/( ]", (label or "").strip().lower())[0]
    return _CODE.get(key)


def train(documents: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_documents: int = 4000) -> tuple[list[str], np.ndarray]:
    """Per-word scores from a bounded sample of labelled rows.

    At most ``max_documents`` labelled rows (those of smallest key hash) are counted, so what reaches the driver and the workers is
    bounded whatever the corpus; every word that three of them hold is in the model. Function words are a prior; with no labelled
    row at all the model is the prior alone. A language that the script of a word rules out gets the lowest score.
    """
    labelled = documents.where(F.col(lang).isin(*LANGUAGES) & F.col(text).isNotNull())
    ids = labelled.select(key).orderBy(F.xxhash64(key), key).limit(max_documents)
    sample = labelled.join(F.broadcast(ids), key, "left_semi").select(lang, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = sample.groupBy("w").agg(*[F.count(F.when(F.col(lang) == x, 1)).alias(x) for x in LANGUAGES], F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = counts.collect()
    table = {r["w"]: np.array([r[x] for x in LANGUAGES], float) for r in rows}
    for i, x in enumerate(LANGUAGES):
        for w in FUNCTION_WORDS[x]:
            table.setdefault(w, np.zeros(4))[i] += 20
    words = sorted(table)
    c = np.array([table[w] for w in words])
    c = (c + 0.1) / (c.max(axis=0, keepdims=True).clip(1) + 1)  # documents (of a language) that hold the word
    score = np.log(c)
    score -= score.mean(axis=1, keepdims=True)
    narrowed = np.array([[x in found for x in LANGUAGES] for found in map(candidates, words)]).reshape(-1, len(LANGUAGES))
    return words, np.where(narrowed | ~narrowed.any(axis=1, keepdims=True), np.clip(score, -3, 3), -3).astype("float32")


def _viterbi(codes: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best label of every scored word of each sequence; sequences of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, "int8")] * len(codes)
    order = sorted((i for i in range(len(codes)) if len(codes[i])), key=lambda i: len(codes[i]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * len(codes[order[stop]]) <= 1_000_000:
            stop += 1
        part = order[start:stop]
        n, longest = len(part), len(codes[part[-1]])
        lengths = np.array([len(codes[i]) for i in part])
        grid = np.full((n, longest), len(scores), "int32")
        for r, i in enumerate(part):
            grid[r, : len(codes[i])] = codes[i]
        table = np.vstack([scores, np.zeros((1, 4), "float32")])
        back = np.empty((longest, n, 4), "int8")
        v = table[grid[:, 0]]
        own = np.arange(4, dtype="int8")[None, :]
        for t in range(1, longest):
            best = v.argmax(axis=1)
            top = v[np.arange(n), best] - penalty
            stay = v >= top[:, None]
            back[t] = np.where(stay, own, best[:, None])
            v = np.where(stay, v, top[:, None]) + table[grid[:, t]]
        state = v.argmax(axis=1)  # words beyond the end score 0 and never switch
        path = np.empty((n, longest), "int8")
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[:, t] = state
            if t:
                state = back[t, rows, state]
        for r, i in enumerate(part):
            out[i] = path[r, : lengths[r]]
        start = stop
    return out


SEGMENTS = (
    "main string, confidence double, segments array<struct<no:int,language:string,confidence:double>>, "
    "spans array<struct<block:int,first_word:int,last_word:int,language:string,confidence:double>>"
)


def label_texts(texts: list[str], words: dict[str, int], scores: np.ndarray, penalty: float = 6.0, min_words: int = 8, margin: float = 6.0) -> list[tuple]:
    """(main, confidence, [(block number, language, confidence)], spans) of each text; blocks are split at blank lines.

    ``spans`` are the runs of Viterbi labels in another language than the main one, of four scored words or more, as (block number,
    first and last word in the block from 1, language, confidence): also where one block mixes languages.

    The main language is the one of most text. A block counts as foreign if it is a running text of
    ``min_words`` words or more, most of it labelled with another language, and its scores lead those of the
    main language by ``margin``; titles, docket lines and names don't. A text is running if half of its words are
    lower case, or, as German nouns and names are not, if its lower-case words alone lead by ``margin``.
    """
    codes, blocks_of = [], []
    for t in texts:
        blocks, code = [], []
        for b in _BLOCK.split(skeleton(t)):
            ws = _WORD.findall(b)
            at = [words.get(w, -1) if _LATIN.search(w) else -1 for w in map(str.lower, ws)]
            known = [a for a in at if a >= 0]
            lower = [w.islower() for w in ws]
            mixed = [a for a, low in zip(at, lower) if low and a >= 0] if sum(lower) < 0.5 * len(ws) else None
            blocks.append((len(known), len(b), len(ws), mixed, [i for i, a in enumerate(at, 1) if a >= 0]))
            code += known
        codes.append(np.array(code, "int32"))
        blocks_of.append(blocks)
    found = []
    for blocks, code, path in zip(blocks_of, codes, _viterbi(codes, scores, penalty)):
        if not len(code):
            found.append((None, 0.0, [], []))
            continue
        at, total, facts = 0, np.zeros(4), []
        for known, size, n, mixed, _ in blocks:
            share = np.bincount(path[at : at + known], minlength=4) / max(known, 1)
            lows = None if mixed is None else scores[mixed].sum(axis=0) if mixed else np.zeros(4)
            # Of few lower-case words, those of running text speak for its language against each other one.
            running = lows is None or n >= min_words and lows[share.argmax()] - np.delete(lows, share.argmax()).max() >= margin
            total += share * size * (1 if running else 0.1)
            facts.append((share, scores[code[at : at + known]].sum(axis=0), lows))
            at += known
        main = int(total.argmax())
        foreign = []
        for no, ((_, _, n, _, _), (share, score, lows)) in enumerate(zip(blocks, facts), 1):
            lang = int(share.argmax())
            lead = float(score[lang] - score[main])
            if lang != main and n >= min_words and lead >= margin and (lows is None or lows[lang] - lows[main] >= margin):
                p = np.exp((score - score.max()) / 4)
                foreign.append((no, LANGUAGES[lang], float(p[lang] / p.sum())))
        spans, at = [], 0
        for no, (known, _, _, _, places) in enumerate(blocks, 1):
            labels = path[at : at + known]
            edges = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), known]
            for a, b in zip(edges, edges[1:]):
                if b - a >= 4 and labels[a] != main:
                    p = scores[code[at + a : at + b]].sum(axis=0)
                    p = np.exp((p - p.max()) / 4)
                    spans.append((no, places[a], places[b - 1], LANGUAGES[labels[a]], float(p[labels[a]] / p.sum())))
            at += known
        found.append((LANGUAGES[main], float(total[main] / total.sum()), foreign, spans))
    return found


def label_languages(df: DataFrame, key: list[str], text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """key columns, main, confidence, segments and spans of each row; null and blank texts have main null.

    Rows are labelled where they are; the model (at most a few MB) goes to the workers in a broadcast variable.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, scores = shared.value
        words = {w: i for i, w in enumerate(names)}
        for pdf in batches:
            done = label_texts([t or "" for t in pdf["_text"]], words, scores)
            out = pdf[key].copy()
            out["main"], out["confidence"] = [d[0] for d in done], [d[1] for d in done]
            out["segments"] = [[{"no": a, "language": b, "confidence": c} for a, b, c in d[2]] for d in done]
            out["spans"] = [[{"block": a, "first_word": b, "last_word": c, "language": x, "confidence": y} for a, b, c, x, y in d[3]] for d in done]
            yield out

    picked = df.select(*key, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "_text") + ", " + SEGMENTS
    return picked.mapInPandas(run, schema)


def wrong_labels(fiches: DataFrame, labelled: DataFrame) -> DataFrame:
    """(fiche_id, segment_no, language, confidence): 0 for a missing or wrong label, k for the foreign block k.

    ``fiches`` has fiche_id, extraction_id and language, one row a fiche; ``labelled`` one row an extraction.
    """
    names = F.create_map(*[F.lit(x) for kv in _CODE.items() for x in kv])
    label = F.try_element_at(names, F.lower(F.get(F.split(F.regexp_replace("language", r"^\s+", ""), r"[-_;,/( ]"), F.lit(0))))
    both = fiches.withColumn("label", label).join(labelled.where("main is not null"), "extraction_id")
    zero = F.when(F.col("label").isNull() | (F.col("label") != F.col("main")), F.array(F.struct(F.lit(0).alias("no"), F.col("main").alias("language"), F.col("confidence"))))
    rows = both.select("fiche_id", F.explode(F.concat(F.coalesce(zero, F.expr("cast(array() as array<struct<no:int,language:string,confidence:double>>)")), "segments")).alias("s"))
    return rows.select("fiche_id", F.col("s.no").alias("segment_no"), "s.language", "s.confidence")
