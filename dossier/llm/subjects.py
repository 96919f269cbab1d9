"""Problem 9: subject areas of each document, by class-association rules.

The sentences of hand-labelled documents are transactions of words and pairs of neighbouring
words (hashes of their letters without accents, so texts that lost theirs match too).
Frequent patterns are mined by parallel frequent-pattern growth: items are counted in
parallel and those that tell subjects apart are ranked, each transaction is sent to the
groups of its items as the prefix that the group needs, and each group grows its own pattern
tree whose nodes count the subjects.  Every rule, of one item or of several, comes out of
these trees.  A rule is a pattern of at most PATTERN items that names a subject with enough
confidence; a longer rule is redundant, and dropped, if a shorter one within it names the
same subject with a confidence that is less by no more than LONGER_GAIN.

One labelled document in FOLD is kept out of mining: a rule's confidence is calibrated on the
sentences of these.  Every document is then scored sentence by sentence: the log odds of the
matching rules add up, the sentence goes to the subject with the most evidence, and a
document has each subject that at least a fifth of its sentences deal with.  All sentences of
an Arrow batch are scored together on arrays.

The rules are fitted on at most LABELLED_DOCUMENTS labelled documents (the least hashes of
their ids); this bounds the rules, which are sent to all tasks.  Scoring covers all rows.

Defined results: null, empty and blank texts have no subject; unknown and blank labels are
ignored; repeated labels count once for each annotator; repeated documents are each scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.textform import consistent_forms
from dossier.llm.neardup import _mix, _word_table, word_hashes
from dossier.plans.shared import cut, table

#: Most labelled documents that the rules are fitted on, and which share of them (1/FOLD) calibrates.
LABELLED_DOCUMENTS, FOLD = 8_000, 10
#: Least documents, and share of the labelled sentences, that hold a rule's pattern; a longer pattern needs LONGER times as many.
LEAST_DOCUMENTS, LEAST_SUPPORT, LONGER = 3, 0.0004, 3
#: Least confidence of a rule, of a longer one, what a longer one must add, and the most items.
LEAST_CONFIDENCE, LONGER_CONFIDENCE, LONGER_GAIN, PATTERN = 0.7, 0.9, 0.1, 3
#: An item is mined if it names a subject, or a subject is this many times as frequent with it as without regard to it.
LEAST_LIFT = 3.0
#: Weight, in sentences, of an even chance in a rule's confidence, and of the mined confidence in the calibrated one.
PRIOR, TRUST = 2.0, 20.0
#: Most confidence that a rule may have.
MOST_SURE = 0.99
GROUPS = 24
#: Log odds that a sentence needs to count for a subject.
EVIDENCE = 1.0
SHARE = 0.2
LEAST_WORDS = 3
#: Texts that are read as one array; size of the table that most words without a rule are sifted out by.
SLICE, KNOWN_BITS = 512, 1 << 20

MARKUP = re.compile(r"</?[a-z]+[^<>]*>")
LEAD = re.compile(r"(?i)(?:\s|\|)*(?:(?:điều|dieu|mục|muc|khoản|khoan|article|section)\s+\d+\s*[.:]|\d+\s*[.)]|[-*•+–]|(?:hỏi|đáp|hoi|dap|q|a|question|answer)\s*:)?")


def fold(word: str) -> str:
    """A lower-case word without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return plain.replace("đ", "d")


@lru_cache(maxsize=1)
def _folded_table() -> np.ndarray:
    """For each BMP code point its lower-case letter without accents."""
    table = np.arange(0x10000, dtype=np.uint32)
    for code in range(0x10000):
        if not 0xD800 <= code < 0xE000:
            table[code] = ord((fold(chr(code).lower()) or chr(code))[0])
    return table


#: Kinds of characters: digits, white space, ends of sentences, ends of lines, and letters that may begin a sentence.
DIGIT, SPACE, END, LINE, CAPITAL = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _kind_table() -> np.ndarray:
    """For each BMP code point its kinds; a sentence begins with a letter that isn't a small one of Latin or Vietnamese."""
    table = np.zeros(0x10000, dtype=np.uint8)
    for code in range(0x10000):
        ch = chr(code)
        small = "a" <= ch <= "z" or "à" <= ch <= "ỹ"
        table[code] = DIGIT * ch.isdigit() + SPACE * ch.isspace() + END * (ch in ".?!") + LINE * (ch in "\r\n") + CAPITAL * (ch.isalnum() and not ch.isdecimal() and not small)
    return table


def _sentence_starts(kinds: np.ndarray) -> np.ndarray:
    """Places where sentences may begin: behind line ends, and at capitals behind an end of a sentence and a blank."""
    if not len(kinds):
        return np.zeros(1, dtype=np.int64)
    lines = np.flatnonzero(kinds & LINE) + 1
    ends = np.flatnonzero(kinds & END)
    ends = ends[(ends + 1 < len(kinds)) & ((kinds[np.minimum(ends + 1, len(kinds) - 1)] & SPACE) > 0)]
    filled = np.flatnonzero((kinds & SPACE) == 0)
    after = np.searchsorted(filled, ends + 1)
    after = filled[after[after < len(filled)]]
    return np.unique(np.concatenate([[0], lines, after[(kinds[after] & CAPITAL) > 0]]))


class Sentences:
    """The words of a list of texts as arrays: ``words`` (hashes), ``number`` (is it one), ``sentence`` of each; ``text`` of each sentence.

    A sentence has at least LEAST_WORDS words behind its numbering or bullet; others are left out.
    """

    def __init__(self, texts: list[str | None]):
        forms = [MARKUP.sub(" ", f) if "<" in f else f for f in (f or "" for f in consistent_forms(texts))]
        joined = "\n".join(forms)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        small = np.minimum(codes, 0xFFFF)
        inside, kinds = _word_table()[small], _kind_table()[small]
        for k in np.flatnonzero(codes > 0xFFFF):
            inside[k] = chr(codes[k]).isalnum()
            kinds[k] = DIGIT * chr(codes[k]).isdigit() + CAPITAL * inside[k]
        starts, ends, words = word_hashes(np.where(codes > 0xFFFF, codes, _folded_table()[small]), inside)
        digits = np.concatenate([[0], np.cumsum(kinds & DIGIT, dtype=np.int64)])
        number = digits[ends] - digits[starts] == ends - starts
        opens = _sentence_starts(kinds)
        sentence = np.searchsorted(opens, starts, side="right") - 1
        bodies = np.zeros(len(opens), dtype=np.int64)
        for k in np.unique(sentence).tolist():
            bodies[k] = LEAD.match(joined, opens[k]).end()
        kept = starts >= bodies[sentence]
        long = np.bincount(sentence[kept], minlength=len(opens)) >= LEAST_WORDS
        kept &= long[sentence]
        used = np.flatnonzero(long)
        self.sentence = (np.cumsum(long) - 1)[sentence[kept]]
        self.words, self.number = words[kept], number[kept]
        stops = np.cumsum([len(f) + 1 for f in forms])
        self.text = np.searchsorted(stops, opens[used], side="right")

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, item) of each word and each pair of neighbours that has no number."""
        word = ~self.number
        pair = word[:-1] & word[1:] & (self.sentence[:-1] == self.sentence[1:])
        pairs = _mix(self.words[:-1] + np.uint64(1)) ^ self.words[1:]
        at = np.concatenate([self.sentence[word], self.sentence[:-1][pair]])
        return at, np.concatenate([self.words[word], pairs[pair]]).view(np.int64)


def item(text: str) -> int:
    """The item of a word or of two neighbouring words."""
    made = Sentences([f"{text} {'x ' * LEAST_WORDS}"])
    return int((made.words[:1] if " " not in text else _mix(made.words[:1] + np.uint64(1)) ^ made.words[1:2]).view(np.int64)[0])


def clean_labels(labels: DataFrame, subjects: DataFrame, limit: int = LABELLED_DOCUMENTS) -> DataFrame:
    """(doc_id, subjects map<string,double>): the share of a document's annotators behind each subject."""
    known = subjects.select(F.lower(F.trim("subject")).alias("subject")).where("subject <> ''").distinct()
    tidy = labels.where("doc_id IS NOT NULL").select("doc_id", F.lower(F.regexp_replace("subject", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("subject"), F.coalesce("annotator", F.lit("")).alias("annotator"))
    tidy = tidy.join(known, "subject").distinct()
    sample = tidy.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    votes = tidy.join(sample, "doc_id").groupBy("doc_id", "subject").agg(F.count(F.lit(1)).alias("votes"))
    people = tidy.groupBy("doc_id").agg(F.countDistinct("annotator").alias("people"))
    shares = votes.join(people, "doc_id").select("doc_id", F.struct("subject", (F.col("votes") / F.col("people")).alias("share")).alias("entry"))
    return shares.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("entry")).alias("subjects"))


def transactions(labelled: DataFrame) -> DataFrame:
    """(doc_id, held, items, subjects) of each sentence of the documents (doc_id, text, subjects); ``held``: kept for calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                made = Sentences(batch.column(2).to_pylist())
                at, items = made.items()
                order = np.lexsort([items, at])
                at, items = at[order], items[order]
                fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (items[1:] != items[:-1])])[: len(at)]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(at[fresh], minlength=len(made.text)))]).astype(np.int32)
                rows = batch.take(pa.array(made.text))
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(items[fresh]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists, rows.column(3)], names=["doc_id", "held", "items", "subjects"])

    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLD)) == 0
    return labelled.select("doc_id", held.alias("held"), "text", "subjects").mapInArrow(run, "doc_id bigint, held boolean, items array<bigint>, subjects map<string,double>")


class PatternTree:
    """Prefix tree of one item group; each node counts its sentences and the weights of their subjects."""

    def __init__(self):
        self.children: dict[tuple[int, int], int] = {}
        self.paths: list[tuple[int, ...]] = [()]
        self.where: dict[int, list[int]] = defaultdict(list)
        self.subjects: dict[str, int] = {}
        self.visits: list[int] = []
        self.visitors: list[tuple[int, dict[str, float]]] = []
        self.weights: np.ndarray | None = None

    def add(self, items: list[int], subjects: dict[str, float]) -> None:
        """One sentence; ``items`` in the order of their ranks."""
        node, self.weights = 0, None
        for item in items:
            child = self.children.get((node, item))
            if child is None:
                child = self.children[(node, item)] = len(self.paths)
                self.paths.append((*self.paths[node], item))
                self.where[item].append(child)
            node = child
            self.visits.append(node)
        self.visitors.append((len(items), subjects))
        for subject in subjects:
            self.subjects.setdefault(subject, len(self.subjects))

    def _counted(self) -> np.ndarray:
        """For each node the weights of the subjects, and the number of sentences as the last column."""
        if self.weights is None:
            own = np.zeros((len(self.visitors), len(self.subjects) + 1))
            own[:, -1] = 1
            for k, (_, subjects) in enumerate(self.visitors):
                for subject, weight in subjects.items():
                    own[k, self.subjects[subject]] = weight
            own = np.repeat(own, [n for n, _ in self.visitors], axis=0)
            self.weights = np.stack([np.bincount(np.array(self.visits, dtype=np.int64), c, len(self.paths)) for c in own.T], axis=1)
        return self.weights

    def grow(self, suffix: int, least: int, size: int) -> Iterator[tuple[list[int], float, dict[str, float]]]:
        """(pattern, sentences, subject weights) of all frequent patterns of at most ``size`` items that end with ``suffix``."""
        nodes = self.where.get(suffix, [])
        weights, paths = self._counted()[nodes], [self.paths[n][:-1] for n in nodes]
        rows = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
        flat = np.array([i for p in paths for i in p], dtype=np.int64)
        total = float(weights[:, -1].sum())
        names = list(self.subjects)
        if total >= least:
            yield [suffix], total, {n: w for n, w in zip(names, weights.sum(axis=0)) if w}
            yield from self._longer([suffix], flat, rows, weights, LONGER * least, size, names)

    def _longer(self, pattern: list[int], flat: np.ndarray, rows: np.ndarray, weights: np.ndarray, least: int, size: int, names: list[str]):
        """The patterns with one item more and beyond; ``flat`` holds the items of the conditional paths, ``rows`` the path of each."""
        if len(pattern) >= size or not len(flat) or weights[:, -1].sum() < least:
            return
        items, which = np.unique(flat, return_inverse=True)
        sums = np.stack([np.bincount(which, c, len(items)) for c in weights[rows].T], axis=1)
        for k in np.flatnonzero(sums[:, -1] >= least):
            longer = [*pattern, int(items[k])]
            yield longer, float(sums[k, -1]), {n: w for n, w in zip(names, sums[k]) if w}
            if len(longer) < size:
                ends = np.flatnonzero(which == k)
                starts = np.searchsorted(rows, rows[ends])
                number = ends - starts
                places = np.repeat(starts - np.cumsum(number) + number, number) + np.arange(number.sum())
                yield from self._longer(longer, flat[places], np.repeat(np.arange(len(ends)), number), weights[rows[ends]], least, size, names)


def informative_items(sentences: DataFrame, least_documents: int, least: int) -> DataFrame:
    """(item, total) of the frequent items that tell subjects apart: the ranked list of the growth."""
    base = sentences.select(F.explode("subjects").alias("subject", "share")).groupBy("subject").agg(F.sum("share").alias("of_all"))
    every = sentences.agg(F.count(F.lit(1)).alias("sentences"))
    exploded = sentences.select("doc_id", "subjects", F.explode("items").alias("item"))
    frequent = exploded.groupBy("item").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("doc_id").alias("docs"))
    frequent = frequent.where((F.col("docs") >= least_documents) & (F.col("total") >= least))
    by_subject = exploded.select("item", F.explode("subjects").alias("subject", "share")).groupBy("item", "subject").agg(F.sum("share").alias("weight"))
    lifted = by_subject.join(frequent, "item").join(F.broadcast(base), "subject").crossJoin(F.broadcast(every))  # one row for each subject, and one row
    lift = (F.col("weight") / F.col("total")) / (F.col("of_all") / F.col("sentences"))
    named = F.col("weight") / F.col("total") >= LEAST_CONFIDENCE - LONGER_GAIN
    return lifted.where((lift >= LEAST_LIFT) | named).groupBy("item").agg(F.first("total").alias("total"))


def mine_rules(sentences: DataFrame, least_documents: int = LEAST_DOCUMENTS, support: float = LEAST_SUPPORT, size: int = PATTERN) -> DataFrame:
    """(items, total, subject, weight) of the frequent patterns of informative items that may name a subject, the rarest item first."""
    least = max(least_documents, ceil(support * sentences.count()))
    found = informative_items(sentences, least_documents, least).collect()  # bounded: items of a bounded sample
    order = {r["item"]: k for k, r in enumerate(sorted(found, key=lambda r: (-r["total"], r["item"])))}

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for items, subjects in zip(frame["items"], frame["subjects"]):
                ranked = sorted((i for i in items.tolist() if i in order), key=order.__getitem__)
                last = {i % GROUPS: k for k, i in enumerate(ranked)}
                rows += [(group, ranked[: k + 1], subjects) for group, k in last.items()]
            yield pd.DataFrame(rows, columns=["grp", "items", "subjects"])

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree, group = PatternTree(), int(frame["grp"].iloc[0])
        for items, subjects in zip(frame["items"], frame["subjects"]):
            tree.add(items.tolist(), dict(subjects))
        rows = [
            (pattern, total, subject, weight)
            for suffix in [i for i in tree.where if i % GROUPS == group]
            for pattern, total, weights in tree.grow(suffix, least, size)
            for subject, weight in weights.items()
            if _sure(weight, total) >= (LONGER_CONFIDENCE if len(pattern) > 1 else LEAST_CONFIDENCE - LONGER_GAIN)
        ]
        return pd.DataFrame(rows, columns=["items", "total", "subject", "weight"])

    dealt = sentences.select("items", "subjects").mapInPandas(deal, "grp int, items array<bigint>, subjects map<string,double>")
    return dealt.groupBy("grp").applyInPandas(grow, "items array<bigint>, total double, subject string, weight double")


def _sure(weight: float, total: float) -> float:
    """Confidence drawn towards an even chance of twelve subjects by PRIOR sentences."""
    return min((weight + PRIOR / 12) / (total + PRIOR), MOST_SURE)


Rules = dict[tuple[int, ...], tuple[str, float]]


def kept_rules(mined: list) -> Rules:
    """pattern -> (subject, confidence), without redundant rules."""
    best: Rules = {}
    for items, total, subject, weight in mined:
        sure = _sure(weight, total)
        if (sure, subject) > best.get(tuple(items), ("", 0.0))[::-1]:
            best[tuple(items)] = (subject, sure)
    out = {}
    for items, (subject, sure) in best.items():
        if subject == "none" or sure < (LEAST_CONFIDENCE if len(items) == 1 else LONGER_CONFIDENCE):
            continue
        shorter = [best.get(part) for n in range(1, len(items)) for part in combinations(items, n)]
        if not any(s and s[0] == subject and s[1] >= sure - LONGER_GAIN for s in shorter):
            out[items] = (subject, sure)
    return out


class Scorer:
    """Subjects of texts by the evidence of their sentences' matching rules."""

    def __init__(self, rules: Rules):
        self.rules = sorted(rules.items(), key=lambda rule: (rule[0][0], rule))
        self.subjects = sorted({s for _, (s, _) in self.rules}, reverse=True)  # of equal evidence, the first counts
        self.subject = np.array([self.subjects.index(s) for _, (s, _) in self.rules], dtype=np.int64)
        self.odds = np.array([log(c / (1 - c)) for _, (_, c) in self.rules])
        self.items = np.unique(np.array([i for p, _ in self.rules for i in p], dtype=np.int64))
        self.known = np.zeros(KNOWN_BITS, dtype=bool)
        self.known[self.items & (KNOWN_BITS - 1)] = True
        # A rule is looked for where its first item occurs, the rarest; the others must stand in the same sentence.
        lead = np.searchsorted(self.items, np.array([p[0] for p, _ in self.rules], dtype=np.int64))
        self.first = np.searchsorted(lead, np.arange(len(self.items)))
        self.number = np.bincount(lead, minlength=len(self.items))
        self.others = np.full((len(self.rules), max([2, *(len(p) for p, _ in self.rules)]) - 1), -1, dtype=np.int64)
        for k, (pattern, _) in enumerate(self.rules):
            self.others[k, : len(pattern) - 1] = np.searchsorted(self.items, np.array(pattern[1:], dtype=np.int64))
        self.part = np.isin(np.arange(len(self.items)), self.others)

    def matches(self, made: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, rule) of each occurrence of a rule of one item, and of each sentence with a longer rule."""
        at, items = made.items()
        maybe = self.known[items & (KNOWN_BITS - 1)]
        at, items = at[maybe], items[maybe]
        place = np.searchsorted(self.items, items)
        known = self.items[np.minimum(place, len(self.items) - 1)] == items if len(self.items) else np.zeros(len(items), bool)
        at, place = at[known], place[known]
        number = self.number[place]
        rule = np.repeat(self.first[place] - np.cumsum(number) + number, number) + np.arange(number.sum())
        rows = np.repeat(at, number)
        single = self.others[rule, 0] < 0
        found_at, found = [rows[single]], [rule[single]]
        if not single.all():
            longer = np.unique(rows[~single] * len(self.rules) + rule[~single])
            part = self.part[place]
            held = np.unique(at[part] * len(self.items) + place[part])
            rows, rule = longer // len(self.rules), longer % len(self.rules)
            good = np.ones(len(rule), bool)
            for other in self.others[rule].T:
                wanted = rows * len(self.items) + other
                good &= (other < 0) | (held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted)
            found_at, found = [*found_at, rows[good]], [*found, rule[good]]
        return np.concatenate(found_at), np.concatenate(found)

    def texts(self, texts: list[str | None], share: float = SHARE) -> tuple[np.ndarray, list[str]]:
        """(place of the text, subject) of each subject that at least ``share`` of a text's sentences deal with."""
        made, width = Sentences(texts), len(self.subjects)
        if not width or not len(made.text):
            return np.empty(0, np.int64), []
        at, rule = self.matches(made)
        evidence = np.bincount(at * width + self.subject[rule], self.odds[rule], len(made.text) * width).reshape(-1, width)
        evidence = np.round(evidence, 9)
        best = evidence.argmax(axis=1)
        sure = evidence[np.arange(len(best)), best] > EVIDENCE
        counts = np.bincount(made.text[sure] * width + best[sure], minlength=len(texts) * width).reshape(-1, width)
        sentences = np.bincount(made.text, minlength=len(texts))
        text, subject = np.nonzero((counts > 0) & (counts >= share * sentences[:, None]))
        return text, [self.subjects[k] for k in subject]


def calibrated(rules: Rules, held: DataFrame) -> Rules:
    """The rules with the confidence that the sentences kept for calibration (items, subjects) give them; the mined one counts as TRUST sentences.

    Rules that turn out to be no better than an even choice between naming the subject and not are dropped.
    """
    patterns = sorted(rules)
    by_item: dict[int, list[int]] = defaultdict(list)
    for k, pattern in enumerate(patterns):
        by_item[pattern[0]].append(k)
    subjects = [rules[p][0] for p in patterns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(len(patterns)), np.zeros(len(patterns))
        for frame in frames:
            for items, shares in zip(frame["items"], frame["subjects"]):
                items, shares = items.tolist(), dict(shares)
                present = set(items)
                for k in (k for i in items for k in by_item.get(i, ())):
                    if present.issuperset(patterns[k]):
                        total[k] += 1
                        weight[k] += shares.get(subjects[k], 0.0)
        met = np.flatnonzero(total)
        yield pd.DataFrame({"rule": met, "total": total[met], "weight": weight[met]})

    counted = held.select("items", "subjects").mapInPandas(run, "rule long, total double, weight double").groupBy("rule").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    seen = {r["rule"]: (r["weight"], r["total"]) for r in counted.collect()}  # bounded by the rules
    out = {}
    for k, pattern in enumerate(patterns):
        subject, sure = rules[pattern]
        weight, total = seen.get(k, (0.0, 0.0))
        sure = min((weight + TRUST * sure) / (total + TRUST), MOST_SURE)
        if sure > 0.5:
            out[pattern] = (subject, sure)
    return out


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame, limit: int = LABELLED_DOCUMENTS, size: int = PATTERN) -> Rules:
    """The rules mined from the labelled documents, calibrated on those kept out."""
    wanted = cut(clean_labels(labels, subjects, limit))
    labelled = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # at most ``limit`` rows
    sentences = cut(transactions(labelled))
    rows = mine_rules(sentences.where("NOT held"), size=size).collect()  # bounded by the sample's bound
    rules = kept_rules([(r["items"], r["total"], r["subject"], r["weight"]) for r in rows])
    return calibrated(rules, sentences.where("held"))


def assign_subjects(documents: DataFrame, rules: Rules, share: float = SHARE) -> DataFrame:
    """(doc_id, subject): each subject that at least ``share`` of a document's sentences deal with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(rules)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                text, subject = scorer.texts(batch.column(1).to_pylist(), share)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(subject, pa.string())], names=["doc_id", "subject"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, subject string")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = fit(documents, table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))
    return assign_subjects(documents, rules)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, documents): how many documents deal with each subject; several subjects count each."""
    return p9_found(spark, sf_dir).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
