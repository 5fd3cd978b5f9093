"""Toxicity by a weighted finite-state grammar over clauses.

A clause is read as a string of word classes: insult, threat, target, negation, reported speech, other. Five transducers
read it, each a table of states and arcs (INSULT, THREAT, TARGET, NEGATION, REPORT below): insult and threat emit a match;
target knows whether one was named before; negation holds for the three words behind it; report holds up to the clause's
end. Whether a target follows a match is not known yet when the match is read, so the target transducer is
nondeterministic: it promises one or none, and only the path whose promises come true is accepted. compose() multiplies the
five into one machine whose arcs emit a match in its context (plain, target, threat, negated, reported) or nothing. A path's
weight is the product over its matches of one minus the match's weight times its context's share; a text's score is what
its clauses' accepted paths leave of one. So it is the matched clause that counts, not the word alone.

A threat needs a target on either side; pronouns that are always subjects are none before the verb. Insults are a seed list
and words and stems (of STEMS letters) that stand in more toxic texts than their rate in blocks of clean ones lets expect. A
learned one that clean texts have too, by chance, is an insult only in the company of another learned one, within COMPANY characters; so a
match counts whatever the text's length is. How much each context counts is calibrated on the labelled
rows, from a prior that holds where no rows show otherwise: by the prior a lone insult without a target isn't toxic.

Labels are learned only from rows with crc32(doc_id) mod 4 other than 2, at most SAMPLE of them, picked by a hash. Nothing
but the text goes into a score.

Nulls: a null text counts as empty, a null id stays null and is not held out. Texts without a match get the share of toxic
rows among such texts, empty ones too. Repeated rows score alike; a label that repeats counts as toxic if any of its rows
does. Words of equal gain are taken in the order of the alphabet. Long texts and long clauses are read whole, in linear
time. Without labels the seed lists and priors work alone. An empty table gives an empty one. Other columns stay as they
are, also one named score, which without_toxic() keeps.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Most labelled rows that the lexicon and the contexts are learned from.
SAMPLE = 4_000
THRESHOLD = 0.3
#: Word classes of the grammar in English, German, French and Spanish. Fixed values.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass idiota estúpido estúpida imbécil basura escoria payaso dummkopf abschaum trottel versager crétin ordure minable"
THREATS = "kill murder hurt destroy beat shoot stab strangle töten umbringen schlagen tuer frapper matar golpear"
TARGETS = "you your yours yourself he she they him her them du dich dir euch sie tu toi vous ton votre tú te usted ustedes"
#: Targets that can't be the object of a verb behind them.
SUBJECTS = "he she they du tú"
NEGATIONS = "not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun no nunca jamás ni sin"
REPORTS = "said says wrote writes claimed claims reported quoted quotes alleged sagte schrieb behauptete dit écrit affirme dijo escribió afirmó"
#: Before any labelled row is seen: how likely a clause of each context makes its text toxic, and how many rows that weighs.
PRIORS = {"plain": 0.25, "target": 0.9, "threat": 0.9, "negated": 0.2, "reported": 0.2}
PRIOR_ROWS = 4.0
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.,;:!?\n|()\"«»]+")
#: Letters of learned stems, which stand for all words that begin with them.
STEMS = range(5, 9)
#: Learned words and stems that clean texts have too count where another learned one begins within so many characters, however long the text is.
COMPANY = 700
#: Words of a block, in which the background's rate of a word is measured.
BLOCK = 100
LEAST_LETTERS = 3  # of learned whole words
LEAST_TEXTS = 3

#: Word classes, as bits of a symbol. A target that can be an object has both of the last two.
I, H, N, R, SUBJECT, OBJECT = 1, 2, 4, 8, 16, 32


def words_of(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: The transducers: state -> (class of the word read -> next state), None for any other word.
NEGATION = {0: {N: 3, None: 0}, 1: {N: 3, None: 0}, 2: {N: 3, None: 1}, 3: {N: 3, None: 2}}
REPORT = {"own": {R: "reported", None: "own"}, "reported": {R: "reported", None: "reported"}}
#: What was named before a match: nobody, somebody as a subject, somebody who can be an object.
TARGET = {"none": {OBJECT: "object", SUBJECT: "subject", None: "none"}, "subject": {OBJECT: "object", SUBJECT: "subject", None: "subject"}, "object": {OBJECT: "object", SUBJECT: "object", None: "object"}}
#: What a match may promise about targets behind it, by the promise that is open, and the promise open then.
PROMISES = {"free": {True: "owed", False: "barred"}, "owed": {True: "owed"}, "barred": {False: "barred"}}
#: What a target does to an open promise: one that is owed is given, one that is barred ends the path.
GIVEN = {"free": "free", "owed": "free"}
ACCEPTED = ("free", "barred")
#: One state each; the word classes at which they emit a match.
INSULT, THREAT = {"at": I}, {"at": H}
START = (0, "own", "none", "free")


def context(kind: int, negated: int, report: str, target: str, behind: bool) -> str | None:
    """The context of a match that the composed machine emits; None for a threat that is aimed at nobody."""
    if kind == THREAT["at"] and not (behind or target == "object"):
        return None
    if report == "reported":
        return "reported"
    if negated:
        return "negated"
    if kind == THREAT["at"]:
        return "threat"
    return "target" if behind or target != "none" else "plain"


@functools.cache
def compose(state: tuple, symbol: int) -> tuple[tuple[tuple, str | None, bool], ...]:
    """The arcs of the product of all five transducers from a state for a symbol: (next state, context emitted, is it a match?)."""
    negated, report, target, promise = state
    made = [(promise, None, False)]
    for kind in (INSULT["at"], THREAT["at"]):
        if symbol & kind:
            made = [(to, context(kind, negated, report, target, behind), True) for behind, to in PROMISES[promise].items()]
            break
    step = lambda machine, at, *classes: next((machine[at][c] for c in classes if symbol & c), machine[at][None])
    after = (step(NEGATION, negated, N), step(REPORT, report, R), step(TARGET, target, OBJECT, SUBJECT))
    if symbol & (SUBJECT | OBJECT):
        made = [(GIVEN[to], emitted, match) for to, emitted, match in made if to in GIVEN]
    return tuple(((*after, to), emitted, match) for to, emitted, match in made)


def accepted(symbols: list[tuple[int, float]]) -> list[tuple[str, float]]:
    """(context, weight) of the matches on the one accepted path over a clause's symbols with their words' weights."""
    paths: dict[tuple, tuple | None] = {START: None}  # each state's matches, the last one first
    for symbol, weight in symbols:
        ahead = {}
        for state, held in paths.items():
            for to, emitted, _ in compose(state, symbol):
                ahead[to] = (held, emitted, weight) if emitted else held
        paths = ahead
    held = next(held for state, held in paths.items() if state[3] in ACCEPTED)
    out = []
    while held:
        held, emitted, weight = held
        out.append((emitted, weight))
    return out[::-1]


@dataclass
class Grammar:
    """Learned stems and whole words (with a blank behind) and their weights, the contexts' shares, the share without a match, and the learned ones that clean texts have too."""

    learned: dict[str, float] = field(default_factory=dict)
    contexts: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    base: float = 0.02
    ambiguous: list[str] = field(default_factory=list)

    def __post_init__(self):
        import ahocorasick

        self.classes: dict[str, int] = {}
        for text, bits in ((INSULTS, I), (THREATS, H), (NEGATIONS, N), (REPORTS, R), (TARGETS, SUBJECT | OBJECT)):
            for word in words_of(text):
                self.classes[word] = self.classes.get(word, 0) | bits
        for word in words_of(SUBJECTS):
            self.classes[word] &= ~OBJECT
        self.weights = {w: 1.0 for w, bits in self.classes.items() if bits & (I | H)}
        self.stems = {}
        for word, weight in self.learned.items():
            if word.endswith(" "):
                self.classes[word[:-1]] = self.classes.get(word[:-1], 0) | I
                self.weights.setdefault(word[:-1], weight)
            else:
                self.stems[word] = weight
        self.doubtful = frozenset(self.ambiguous)
        self.automaton = ahocorasick.Automaton()
        for word in {*self.weights, *self.stems}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def symbols(self, clause: str, alone: frozenset[int] = frozenset()) -> list[tuple[int, float]]:
        """The class and the weight of each word; a word with an apostrophe that no list has is two. alone: where learned words that don't count begin."""
        out = []
        for found in WORD.finditer(clause):
            word, at = found[0], found.start()
            for part in [word] if word in self.classes or "'" not in word else word.split("'"):
                bits, weight = self.classes.get(part, 0), self.weights.get(part, 0.0)
                if bits & I and at in alone and f"{part} " in self.learned:
                    bits, weight = bits & ~I, 0.0
                if not bits & (I | H) and len(part) >= STEMS[0] and at not in alone:
                    weight = max((self.stems.get(part[:n], 0.0) for n in STEMS), default=0.0)
                    bits |= I if weight else 0
                out.append((bits, weight))
                at += len(part) + 1
        return out

    def matches(self, text: str) -> list[tuple[str, float]]:
        """(context, weight) of each match of a text, clause by clause; only clauses that hold an insult or a threat are read."""
        low = text.lower()
        hits, taught, sure = set(), set(), set()
        for last, word in self.automaton.iter(low):
            start = last - len(word) + 1
            if (not start or not low[start - 1].isalpha()) and (word in self.stems or not low[last + 1 : last + 2].isalpha()):
                entry = word if word in self.stems else f"{word} "
                hits.add(start)
                (taught if entry in self.learned else sure).add(start)
                if entry in self.learned and entry not in self.doubtful:
                    sure.add(start)
        out: list[tuple[str, float]] = []
        if not hits:
            return out
        taught = sorted(taught)
        gaps = [COMPANY + 1, *(b - a for a, b in zip(taught, taught[1:])), COMPANY + 1]
        alone = {start for i, start in enumerate(taught) if min(gaps[i], gaps[i + 1]) > COMPANY} - sure
        breaks, begin, limit, after = CLAUSE.finditer(low), 0, -1, 0
        for start in sorted(hits):
            if start < limit or start in alone:
                continue  # in the clause that was read last, or doubtful and alone
            while start >= limit:
                mark, begin = next(breaks, None), after
                limit, after = mark.span() if mark else (len(low) + 1, len(low))
            out += accepted(self.symbols(low[begin:limit], frozenset(at - begin for at in alone if begin <= at < limit) if alone else frozenset()))
        return out

    def score(self, text: str) -> float:
        """Chance that any of the matched clauses makes the text toxic."""
        clean = 1.0 - self.base
        for kind, weight in self.matches(text):
            clean *= 1.0 - min(0.999, weight * self.contexts[kind])
            if clean < 1e-6:
                break
        return 1.0 - clean


def features(words: list[str]) -> set[str]:
    """The words, with a blank behind, and the stems of longer ones."""
    every = set(words)
    out = {f"{w} " for w in every if len(w) >= LEAST_LETTERS}
    for size in STEMS:
        out.update(w[:size] for w in every if len(w) > size)
    return out


def families(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without those that share two of their four smallest clause hashes with earlier ones: copies and near copies."""
    seen: set[int] = set()
    out = []
    for text, toxic in rows:
        least = heapq.nsmallest(4, {zlib.crc32(c.strip().encode()) for c in CLAUSE.split(text.lower()) if c.count(" ") > 2})
        if sum(h in seen for h in least) < 2:
            out.append((text, toxic))
        seen.update(least)
    return out


def lexicon(rows: list[tuple[str, int]]) -> dict[str, float]:
    """The words and stems of evidence() with their weights."""
    return evidence(rows)[0]


def evidence(rows: list[tuple[str, int]]) -> tuple[dict[str, float], list[str]]:
    """Words and stems, and those of them that clean texts have too, that stand in far more toxic texts than their rate in clean ones lets expect, without those that another one covers.

    The background is the share of the clean texts' blocks of BLOCK words that have a word, so that long texts, clean or toxic, count by their length."""
    rows = families(rows)
    hits, background, clean, sizes = Counter(), Counter(), 0, []
    for text, toxic in rows:
        words = WORD.findall(text.lower())
        blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
        if toxic:
            hits.update(features(words))
            sizes.append(len(blocks))
        else:
            clean += len(blocks)
            for block in blocks:
                background.update(features(block))
    needed = math.log(len(hits) + 1) + 3
    seeds = words_of(INSULTS) | words_of(THREATS)
    lengths = Counter(sizes)
    fit_for, gains = {}, {}
    for word, hit in hits.items():
        if hit >= LEAST_TEXTS and word.rstrip() not in seeds:
            rate = (background[word] + 1) / (clean + 2)
            expected = sum(n * (1 - (1 - rate) ** size) for size, n in lengths.items())
            if hit >= 4 * expected and hit * math.log(hit / expected) - (hit - expected) >= needed:
                fit_for[word], gains[word] = (hit - expected + 1) / (hit + 2), hit * math.log(hit / expected) - (hit - expected)
    kept: dict[str, float] = {}
    for word in sorted(fit_for, key=lambda w: (-gains[w], w)):  # what tells most first
        wider = any(word.startswith(x) for x in kept if not x.endswith(" "))
        inside = [w for w in (*kept, *(f"{x} " for x in seeds)) if w.startswith(word)]
        if not wider and all(4 * hits[word] > 5 * hits[w] for w in inside):
            kept[word] = fit_for[word]
    return dict(sorted(kept.items())), sorted(w for w in kept if background[w])


def learned(rows: list[tuple[str, int]]) -> Grammar:
    """The grammar that labelled texts give."""
    if not rows:
        return Grammar()
    words, ambiguous = evidence(rows)
    grammar = Grammar(words, ambiguous=ambiguous)
    hits, seen, quiet = Counter(), Counter(), [0, 0]
    for text, toxic in rows:
        contexts = {c for c, _ in grammar.matches(text)}
        if not contexts:
            quiet[toxic] += 1
        if len(contexts) == 1:
            (only,) = contexts
            hits[only] += toxic
            seen[only] += 1
    shares = {c: (hits[c] + PRIOR_ROWS * p) / (seen[c] + PRIOR_ROWS) for c, p in PRIORS.items()}
    return Grammar(words, shares, (quiet[1] + 0.02 * 50) / (sum(quiet) + 50), ambiguous)


def held_out(id_col: str = "doc_id"):
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learns from at most about SAMPLE labelled rows in one task; only the grammar, of bounded size, reaches the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    known = known.where(~held_out())
    share = min(1.0, SAMPLE / max(1, known.count()))
    picked = known.where(F.xxhash64("doc_id", F.lit(8)).bitwiseAND(0xFFFFFF) < share * 0x1000000)
    rows = docs.select("doc_id", common.clean_text().alias("__text")).join(F.broadcast(picked), "doc_id")  # SAMPLE bounds what is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), map(int, batch.column(1).to_pylist()))
        g = learned(sorted(held))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([g.learned, g.contexts, g.base, g.ambiguous])])], names=["grammar"])

    common.small_batches(docs.sparkSession)
    made = rows.select("__text", "__toxic").repartition(1).mapInArrow(common.frugal(run), "grammar string").collect()
    return Grammar(*json.loads(made[0][0])) if made else Grammar()


def scored(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """docs with a score."""
    common.small_batches(docs.sparkSession)
    made = json.dumps([grammar.learned, grammar.contexts, grammar.base, grammar.ambiguous])
    at = docs.columns.index(text_col)
    rows = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*json.loads(made))
        for batch in batches:
            scores = [g.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(common.frugal(run), f"{fields}, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below the threshold, with their own columns."""
    plain = docs.withColumnRenamed("score", "__score") if "score" in docs.columns else docs
    kept = scored(plain, fit(docs, labels)).where(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnRenamed("__score", "score") if "score" in docs.columns else kept
