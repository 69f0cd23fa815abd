"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms (words, and stems that many words begin with) are learned from labelled rows. The terms' trie is intersected with
the automata that accept what is within one edit of a term: a state is the set of (trie node, edits so far) that a
word's letters lead to, made when first reached and kept. A word runs through it once, a letter a step; nearly all words
reach the empty set after a few letters. Words that fail are tried with two neighbouring letters swapped, and terms of four
letters with one letter masked. What stands within a window around a hit (second person against quotation
marks and words of report) separates abuse from quotation. A logistic model on these features gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdem.llm import simhash
from sparkdem.llm.common import arrow_map, hashed_sample, materialise, small_batches

#: Words, also with letters masked inside.
WORD = re.compile(r"[^\W_]+(?:[*@$!#][^\W_]+)*")
#: The model is fitted on at most so many labelled rows: those with the least hash of their id.
MOST_LABELLED = 50_000
#: At most so many terms; stems have so many letters; a term is this many times as common among toxic texts.
MOST_TERMS, STEM, LIFT = 400, range(4, 8), 15.0
#: A term occurs in this share of the toxic rows at least, and its count times the logarithm of its lift reaches this.
SHARE, EVIDENCE = 0.01, 14.0
#: At most so many words near a term are remembered as ordinary ones.
MOST_ORDINARY = 20_000
#: A term whose neighbours are ordinary words in more than this share of the rows that aren't toxic is found exactly only.
COMMON_NEIGHBOURS = 0.002
#: Terms that a task counts before it passes their counts on, a bound of memory.
TERMS_AT_A_TIME = 100_000
#: Terms of so many letters or more are also found with one edit. Words on either side of a hit that are its context.
FUZZY_FROM, WINDOW = 5, 6
#: Terms of so many letters are found with one letter masked: by a sign, a digit, or a letter that looks like it.
MASKED, SIGNS = 4, frozenset("*@$!#0123456789")
LOOKALIKES = frozenset({("u", "v"), ("v", "u"), ("i", "l"), ("l", "i"), ("i", "j"), ("k", "c"), ("c", "k"), ("s", "z"), ("z", "s")})
#: Words of address, words of report, and quotation marks.
ADDRESS = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre eres ti tus usted ustedes".split())
REPORT = frozenset("said says say quote quoted wrote writes called calls word words term terms reported sagte sagt schrieb wort dit écrit mot dijo dice palabra".split())
MARKS = re.compile("[\"“”„«»‘’]")
FEATURES = 8


class Matcher:
    """The terms' trie intersected with the automata of one edit. terms: (letters, whether a stem)."""

    def __init__(self, terms: list[tuple[str, bool]], exact_only: frozenset = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.letters = frozenset(c for t, _ in terms for c in t)
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        for i, (t, stem) in enumerate(terms):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            (self.stem_at if stem else self.word_at).setdefault(node, i)
        self.fuzzy = [not stem and len(t) >= FUZZY_FROM and t not in exact_only for t, stem in terms]
        self.swapped: dict[str, int] = {}
        self.masked: dict[str, list[tuple[str, int]]] = {}
        for i, (t, stem) in enumerate(terms):
            if self.fuzzy[i]:
                for k in range(len(t) - 1):
                    self.swapped.setdefault(t[:k] + t[k + 1] + t[k] + t[k + 2 :], i)
            elif not stem and len(t) == MASKED and t not in exact_only:
                for k in range(MASKED):
                    self.masked.setdefault(f"{k}{t[:k]}{t[k + 1 :]}", []).append((t[k], i))
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.accepts: list[tuple[int, int] | None] = []
        self.stems: list[int | None] = []
        self.moves: dict[tuple[int, str], int] = {}
        self.dead = self.state(frozenset())
        self.start = self.state(self.closed({(0, 0)}))

    def closed(self, found: set) -> frozenset:
        """With the nodes that leaving out one letter of a term leads to."""
        return frozenset(found | {(n, 1) for s, e in found if not e for n in self.children[s].values()})

    def state(self, found: frozenset) -> int:
        if found not in self.number:
            self.number[found] = len(self.sets)
            self.sets.append(found)
            ends = [(e, self.word_at[n]) for n, e in found if n in self.word_at and (not e or self.fuzzy[self.word_at[n]])]
            self.accepts.append(min(ends)[::-1] if ends else None)
            stems = [self.stem_at[n] for n, e in found if not e and n in self.stem_at]
            self.stems.append(stems[0] if stems else None)
        return self.number[found]

    def move(self, at: int, c: str) -> int:
        found = set()
        for n, e in self.sets[at]:
            if c in self.children[n]:
                found.add((self.children[n][c], e))
            if not e:  # another letter in place of one, or one too many
                found |= {(x, 1) for x in self.children[n].values()} | {(n, 1)}
        self.moves[at, c] = to = self.state(self.closed(found))
        return to

    def find(self, word: str) -> tuple[int, str] | None:
        """(term, kind) of the best match: exact, then stem, then fuzzy."""
        at, stem = self.start, None
        for c in word:
            c = c if c in self.letters else ""  # all letters that no term has lead the same way
            to = self.moves.get((at, c))
            at = self.move(at, c) if to is None else to
            if at == self.dead:
                break
            if stem is None:
                stem = self.stems[at]
        end = self.accepts[at]
        if end and not end[1]:
            return end[0], "exact"
        if stem is not None:
            return stem, "stem"
        return (end[0], "fuzzy") if end else None

    def find_disguised(self, word: str) -> tuple[int, str] | None:
        """(term, kind) of a term with two neighbouring letters swapped, or of four letters with one of them masked."""
        if word in self.swapped:
            return self.swapped[word], "fuzzy"
        if len(word) == MASKED:
            for k, c in enumerate(word):
                for letter, term in self.masked.get(f"{k}{word[:k]}{word[k + 1 :]}", ()):
                    if c in SIGNS or (letter, c) in LOOKALIKES:
                        return term, "fuzzy"
        return None


class Scanner:
    """Hits and features of texts; remembers what words are and aren't hits."""

    def __init__(self, model: dict, remember: int = 100_000):
        self.matcher, self.weights, self.remember = Matcher(model["terms"], frozenset(model["exact_only"])), model["evidence"], remember
        self.ordinary = frozenset(model["ordinary"])
        self.clean = set(self.ordinary)
        self.hit: dict[str, tuple[int, str]] = {}

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, str, int, int]], int]:
        """((start, end, term, kind, words of address around, signs of quotation around) of each hit, number of words)."""
        low = text.lower()
        words = WORD.findall(low)
        for w in set(words) - self.clean - self.hit.keys():
            found = self.matcher.find(w) or self.matcher.find_disguised(w)
            if found:
                self.hit[w] = found
            else:
                self.clean.add(w)
        if self.hit.keys().isdisjoint(words):
            out = []
        else:
            spans = [m.span() for m in WORD.finditer(low)]
            out = []
            for i, w in enumerate(words):
                if w in self.hit:
                    near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
                    a, b = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
                    quotes = len(MARKS.findall(low, a, b)) + sum(x in REPORT for x in near)
                    out.append((*spans[i], *self.hit[w], sum(x in ADDRESS for x in near), quotes))
        if len(self.clean) + len(self.hit) > self.remember:
            self.clean = set(self.ordinary)
            self.hit.clear()
        return out, len(words)

    def features(self, text: str) -> list[float]:
        """One row for the model: evidence of exact, stem and fuzzy hits, their number, density, address, quotation."""
        hits, n = self.hits(text)
        of = Counter()
        for _, _, term, kind, _, _ in hits:
            of[kind] += self.weights[term]
        return [
            1.0,
            math.log1p(of["exact"]),
            math.log1p(of["stem"]),
            math.log1p(of["fuzzy"]),
            float(bool(hits)),
            len(hits) / max(1, n),
            math.log1p(sum(h[4] for h in hits)),
            math.log1p(sum(h[5] for h in hits)),
        ]


def learn_terms(labelled: DataFrame) -> list[tuple[str, bool, float]]:
    """(letters, whether a stem, evidence) of the terms that set toxic rows (text, toxic) apart, within the usual bound."""
    return terms_and_beyond(labelled)[0]


def terms_and_beyond(labelled: DataFrame, most_terms: int = MOST_TERMS) -> tuple[list[tuple[str, bool, float]], int]:
    """((letters, whether a stem, evidence) of the terms that set toxic rows (text, toxic) apart, number of those beyond). At most
    most_terms, and as many words that stems find too, since misspellings are those of words."""

    def run(batches):
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(WORD.findall((t.as_py() or "").lower()))
                found = seen[bool(toxic)]
                found.update("=" + w for w in words)
                found.update({"^" + w[:k] for w in words for k in STEM if len(w) > k})
                if len(found) > TERMS_AT_A_TIME:
                    yield list(found), [bool(toxic)] * len(found), list(found.values())
                    found.clear()
        for toxic, found in seen.items():
            yield list(found), [toxic] * len(found), list(found.values())

    marks = arrow_map(labelled.select("text", F.col("toxic") == 1), run, "term string, toxic boolean, n long")
    bad, good = labelled.agg(F.sum(F.expr("int(toxic = 1)")), F.sum(F.expr("int(toxic <> 1)"))).first()
    if not bad or not good:
        return [], 0
    n = marks.groupBy("term").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c"))
    lift = (F.col("t") / bad) / ((F.col("c") + 0.5) / good)
    kept = n.where((F.col("t") >= SHARE * bad) & (lift >= LIFT) & (F.col("t") * F.log(lift) >= EVIDENCE)).withColumn("w", F.log(lift)).orderBy(F.desc(F.col("t") * F.col("w")), "term")
    kept = materialise(kept, "terms")
    found = kept.count()
    kept = kept.orderBy(F.desc(F.col("t") * F.col("w")), "term").limit(4 * most_terms).collect()
    words = {r.term[1:]: r for r in kept if r.term[0] == "="}
    stems = {r.term[1:]: r for r in kept if r.term[0] == "^"}
    # a stem counts if no single word makes up most of it, and if no shorter stem finds nearly all that it finds
    most = {s: max((r.t for w, r in words.items() if w.startswith(s)), default=0) for s in stems}
    good_stems: dict[str, object] = {}
    for s in sorted(stems, key=len):
        if most[s] < 0.7 * stems[s].t and not any(s.startswith(x) for x in good_stems):
            good_stems[s] = stems[s]
    terms = [(s, True, r) for s, r in good_stems.items()] + [(w, False, r) for w, r in words.items() if not any(w.startswith(s) for s in good_stems)]
    covered = [(w, False, r) for w, r in words.items() if any(w.startswith(s) for s in good_stems)]
    for x in (terms, covered):
        x.sort(key=lambda x: (-x[2].t * x[2].w, x[0]))
    chosen = terms[:most_terms] + covered[:most_terms]
    return [(t, stem, float(r.w)) for t, stem, r in chosen], found - len(kept) + len(terms) + len(covered) - len(chosen)


def learn_ordinary(labelled: DataFrame, model: dict) -> tuple[list[str], list[str]]:
    """The words and terms of ordinary_and_beyond, within the usual bound."""
    return ordinary_and_beyond(labelled, model)[:2]


def ordinary_and_beyond(labelled: DataFrame, model: dict, most_ordinary: int = MOST_ORDINARY) -> tuple[list[str], list[str], int]:
    """Of words one edit from a term, those that rows (text, toxic) which aren't toxic use about as often as toxic ones
    do, most_ordinary at most; the terms that have too many such neighbours; and the number of such words beyond."""

    def run(batches):
        scanner, seen = Scanner(model), {True: Counter(), False: Counter()}
        for batch in batches:
            for t, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                low = (t.as_py() or "").lower()
                seen[bool(toxic)].update({(low[h[0] : h[1]], h[2]) for h in scanner.hits(low)[0] if h[3] == "fuzzy"})
        for toxic, found in seen.items():
            yield [w for w, _ in found], [k for _, k in found], [toxic] * len(found), list(found.values())

    n = arrow_map(labelled.select("text", F.col("toxic") == 1), run, "word string, term int, toxic boolean, n long")
    n = n.groupBy("word", "term").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c"))
    bad, good = (x or 0 for x in labelled.agg(F.sum(F.expr("int(toxic = 1)")), F.sum(F.expr("int(toxic <> 1)"))).first())
    usual = n.where((F.col("c") > 0) & (F.col("t") / max(1, bad) < LIFT * F.col("c") / max(1, good)))
    usual = materialise(usual, "usual")
    words = usual.orderBy(F.desc("c"), "word").limit(most_ordinary).collect()
    many = usual.groupBy("term").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON_NEIGHBOURS * good).collect()
    return [r.word for r in words], [model["terms"][r.term][0] for r in many], usual.count() - len(words)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model, by Newton steps. Each toxic row is seen once more with its exact hits misspelled,
    at half weight, since labelled texts seldom show misspellings that people use to get past a filter."""
    more = x[(y == 1) & (x[:, 1] > 0)].copy()
    more[:, 3], more[:, 1] = np.logaddexp(more[:, 3], more[:, 1]), 0.0
    x, y, m = np.vstack([x, more]), np.concatenate([y, np.ones(len(more))]), np.concatenate([np.ones(len(y)), np.full(len(more), 0.5)])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (m * (y - p)) - keep * w
        step = np.linalg.solve((x * (m * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), g)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, most_terms: int = MOST_TERMS, most_ordinary: int = MOST_ORDINARY) -> dict:
    """A model from labelled texts, one of each group of near copies: labels has id_col and toxic; rows with a null in either don't count, and of labels
    that differ for one id the larger does. Without rows of both kinds the model gives every text the share of toxic
    rows (0 without any). Bounds of the model: labelled rows, terms, and ordinary words; the model's `cut` tells how many terms
    and words there were beyond them. Of rows that repeat an id with different texts one counts, of the least hash."""
    wanted = labels.where(f"{id_col} is not null and toxic is not null").groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    wanted = hashed_sample(wanted, ["__id"], most_labelled)
    docs = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text"))
    sample = docs.join(F.broadcast(wanted), "__id")  # at most most_labelled rows
    sample = materialise(sample.groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")
    # copies of one toxic text would make terms of all its rare words
    sample = materialise(simhash.keep_representatives(sample, "__id", "text").select("text", "toxic"), "labelled")
    terms, beyond = terms_and_beyond(sample, most_terms)
    model = {"terms": [(t, s) for t, s, _ in terms], "evidence": [w for _, _, w in terms], "ordinary": [], "exact_only": [], "weights": [-30.0] + [0.0] * (FEATURES - 1)}
    model["ordinary"], model["exact_only"], words_beyond = ordinary_and_beyond(sample, model, most_ordinary)
    model["cut"] = {"terms": beyond, "ordinary": words_beyond}
    got = np.array([r.x + [float(r.toxic == 1)] for r in features(sample.withColumn("id", F.col("toxic").cast("long")), model).withColumnRenamed("id", "toxic").collect()])
    if len(got):
        y = got[:, -1]
        if 0 < y.sum() < len(y):
            model["weights"] = fit(got[:, :-1], y).tolist()
        else:
            model["weights"][0] = 30.0 if y.sum() else -30.0
    return model


def features(df: DataFrame, model: dict) -> DataFrame:
    """id, x (the model's features) of rows id, text."""

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            yield batch.column(0), [scanner.features(t.as_py() or "") for t in batch.column(1)]

    return arrow_map(df.select("id", "text"), run, "id long, x array<double>")


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row; null and empty texts are scored like texts without hits."""
    found = features(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), model)
    z = sum((F.element_at("x", i + 1) * w for i, w in enumerate(model["weights"])), F.lit(0.0))
    return found.select("id", (1 / (1 + F.exp(-F.greatest(F.lit(-700.0), z)))).alias("score"))


def spans(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, end, term, kind, address, quotation of every hit in every text."""

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            rows = [(i, *h) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for h in scanner.hits(t.as_py() or "")[0]]
            yield [[r[k] if k != 3 else model["terms"][r[3]][0] for r in rows] for k in range(7)]

    schema = "id long, start int, end int, term string, kind string, address int, quotation int"
    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, schema)


def keep_clean(df: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose text scores below the threshold. A null or empty text scores like one without hits; rows
    that repeat are judged each, so all stay or all go; an empty table gives no rows."""
    columns, types = df.columns, df.schema
    at, weights = columns.index(text_col), np.array(model["weights"])
    small_batches(df.sparkSession)

    def run(batches):
        scanner = Scanner(model)
        for batch in batches:
            x = np.array([scanner.features(str(t.as_py() or "")) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -700, 700))) < threshold))

    return df.mapInArrow(run, types)
